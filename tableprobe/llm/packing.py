"""Vector best-fit packing of token sequences.

A bin has residual capacities in tokens, in documents and in attention cost (the sum of squared lengths). A
piece goes to a bin that holds it under every constraint: the one that minimises the weighted norm of what
would remain (``rule="norm"``), or that maximises the weighted dot product of demand and residual
(``rule="dot"``). Pieces come longest first. They are dealt at random into groups of about ``group_pieces``
which are packed apart; bins that a group leaves short of ``refill`` of their tokens are opened again and
packed in a second round, so that groups cost next to nothing in bins.

Defined cases: a null text is an empty one and holds the end token only; a null doc_id stays null; repeated
rows are packed each; an empty table gives no rows. Only documents longer than a sequence are cut.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprobe.llm.common import durable, schema_of
from tableprobe.llm.tokens import release, word_encoder


def pieces(
    docs: DataFrame, tokenizer_path: str, max_tokens: int = 4096, end_id: int = 1, keep_memo: bool = True, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, with_ids, ids (little-endian unsigned 32-bit) of every document and
    its end token.

    With keep_memo a worker remembers words from task to task: faster, but it holds some 100 MB between tasks."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    types = dict(zip(names, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = word_encoder(tokenizer_path), np.array([end_id], "<u4")
        for batch in batches:
            keys, held = batch.column(0), 0
            rows: list[int] = []
            out: dict[str, list] = {name: [] for name in names}

            def flush(keys=keys):
                made = [keys.take(pa.array(rows, "int64")), *(pa.array(out[name], types[name]) for name in names)]
                rows.clear()
                for x in out.values():
                    x.clear()
                return pa.RecordBatch.from_arrays(made, ["doc_id", *names])

            for row, ids in enumerate(encode(batch.column(1).to_pylist())):
                data = np.concatenate([ids, end]).tobytes()
                for k, at in enumerate(range(0, len(data), 4 * max_tokens)):
                    part = data[at : at + 4 * max_tokens]
                    rows.append(row)
                    for name, x in zip(names, (k, at // 4, len(part) // 4, zlib.crc32(part), part), strict=False):
                        out[name].append(x)
                    held += len(part) if with_ids else 40
                if held > 8_000_000:
                    yield flush()
                    held = 0
            yield flush()
        if not keep_memo:
            encode.forget()
        release()

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


@dataclass(frozen=True)
class Capacity:
    """What a bin holds, and how much each dimension weighs when bins are compared."""

    tokens: int = 4096
    documents: int = 4096
    attention: int = 4096 * 4096
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)


def best_fit(lengths: np.ndarray, cap: Capacity, rule: str = "norm") -> np.ndarray:
    """The bin of each of the lengths, which must fall: vector best-fit, bins numbered from 0."""
    if rule not in ("norm", "dot"):
        raise ValueError(f"no such rule: {rule}")
    full = np.array([cap.tokens, cap.documents, cap.attention], float)
    weights = np.array(cap.weights)
    demand = np.stack([lengths, np.ones(len(lengths)), lengths.astype(float) ** 2], 1)
    if (demand > full).any():
        raise ValueError("a piece is larger than a sequence")
    residual, number = np.empty((len(lengths), 3)), np.empty(len(lengths), "int64")
    n_open, n_bins, out = 0, 0, np.empty(len(lengths), "int64")
    smallest = demand[-1] if len(lengths) else None
    for k, need in enumerate(demand):
        left = residual[:n_open] - need
        fits = (left >= 0).all(1)
        if fits.any():
            if rule == "norm":
                value = np.where(fits, -(((left / full) ** 2) @ weights), -np.inf)
            else:
                value = np.where(fits, (residual[:n_open] / full) @ (weights * need / full), -np.inf)
            at = int(value.argmax())
        else:
            at, n_open = n_open, n_open + 1
            residual[at], number[at] = full, n_bins
            n_bins += 1
        residual[at] -= need
        out[k] = number[at]
        if (residual[at] < smallest).any():  # nothing that is to come fits: close it
            n_open -= 1
            residual[at], number[at] = residual[n_open], number[n_open]
    return out


def _pack_groups(items: DataFrame, cap: Capacity, rule: str) -> DataFrame:
    """items with bin, offset and fill, packed within each grp."""
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("row", "ascending")])
        lengths = group["length"].to_numpy()
        bins = best_fit(lengths, cap, rule)
        order = np.argsort(bins, kind="stable")
        ends = np.cumsum(lengths[order])
        starts = ends - lengths[order]
        first = np.r_[True, bins[order][1:] != bins[order][:-1]]
        offset = np.empty(len(bins), "int64")
        offset[order] = starts - np.maximum.accumulate(np.where(first, starts, 0))
        fill = np.bincount(bins, lengths, minlength=1).astype("int64")[bins]
        return group.append_column("bin", pa.array(bins)).append_column("offset", pa.array(offset)).append_column("fill", pa.array(fill))

    return items.groupBy("grp").applyInArrow(run, schema_of(items) + ", bin long, offset long, fill long")


def pack(items: DataFrame, cap: Capacity = Capacity(), rule: str = "norm", group_pieces: int = 8192, refill: float = 0.995) -> DataFrame:
    """items (doc_id, piece, length and more columns) with sequence_id and offset. Columns of the names used
    here (row, grp, bin, fill, sequence_id, offset) are replaced."""
    items = items.drop("row", "grp", "bin", "fill", "sequence_id", "offset")
    names, keep = items.columns, [c if c in ("doc_id", "piece", "length") else f"x{k}" for k, c in enumerate(items.columns)]
    items = items.toDF(*keep)  # others may have names of any kind
    items = durable(items.withColumn("row", F.monotonically_increasing_id()))

    def grouped(df: DataFrame, n: int, salt: int) -> DataFrame:
        groups = max(1, math.ceil(n / group_pieces))
        return df.withColumn("grp", F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(groups)))

    first = durable(_pack_groups(grouped(items, items.count(), 1), cap, rule))
    done = first.filter(F.col("fill") >= refill * cap.tokens)
    short = first.filter(F.col("fill") < refill * cap.tokens).drop("grp", "bin", "offset", "fill")
    second = _pack_groups(grouped(short, short.count(), 2), cap, rule)
    number = lambda top: (F.lit(top << 62) + F.shiftleft(F.col("grp").cast("long"), 31) + F.col("bin")).alias("sequence_id")
    return done.select(*keep, number(0), "offset").unionByName(second.select(*keep, number(1), "offset")).toDF(*names, "sequence_id", "offset")
