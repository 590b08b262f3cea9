"""Embedding near-dedup: random-hyperplane sign hashing in several tables, exact cosines, components.

Equal vectors are one class. Each class has a code of ``bits`` signs in each table; classes with equal codes
in a table are compared exactly, block by block, with one matrix product. Bits grow with the number of
classes so that buckets stay at ``bucket`` classes; tables follow from bits so that a pair at the threshold
is missed with a chance of ``miss`` at most. A bucket beyond ``block`` classes is cut into blocks whose pairs
are compared in tasks of their own. A link is counted in the first table where its two codes agree, so no
pair is ever written out: a task returns a count per class and the edges of a spanning forest.

Defined cases: vectors that are null, of no or another dimension, zero or with null or non-finite components
link with nothing; a null id has links but is never the id of a component with other ids; repeated rows are
vectors like any other; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableprobe.llm.common import durable
from tableprobe.llm.components import connected_components


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.9
    miss: float = 1e-5
    bucket: int = 512
    block: int = 2048
    seed: int = 7

    def shape(self, n: int) -> tuple[int, int]:
        """Bits and tables for n classes."""
        bits = min(30, max(4, math.ceil(math.log2(max(n, 1) / self.bucket))))
        agree = (1 - math.acos(self.threshold) / math.pi) ** bits
        return bits, math.ceil(math.log(self.miss) / math.log(1 - agree))


def vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, vec (bytes; null where a vector cannot link) and digest (null likewise) of each row."""
    kind = rows.schema[id_col].dataType.simpleString()
    single = isinstance(rows.schema[vec_col].dataType.elementType, T.FloatType)
    dtype, cast = ("<f4", "array<float>") if single else ("<f8", "array<double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, out = batch.column(1), []
            values = column.values.to_numpy(zero_copy_only=False).astype(dtype, copy=False)
            offsets, valid = column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
            for k in range(len(column)):
                x = values[offsets[k] : offsets[k + 1]]
                wide = x.astype("f8")
                top = np.abs(wide).max() if valid[k] and len(x) and np.isfinite(wide).all() else 0
                if top and not 1e-150 < top < 1e150:  # squares would leave the range of doubles; cosines stay as they are
                    x = (wide / top).astype(dtype)
                out.append(x.tobytes() if top else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, "binary")], ["vec_id", "vec"])

    made = rows.select(F.col(id_col), F.col(vec_col).cast(cast)).mapInArrow(run, f"vec_id {kind}, vec binary")
    return made.withColumn("digest", F.unhex(F.md5("vec")))


def _coded(classes: DataFrame, dtype: str, bits: int, tables: int, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits)
        for batch in batches:
            codes = []
            for v in batch.column("vec").to_pylist():
                x = np.frombuffer(v, dtype).astype("f8")
                if len(x) not in planes:
                    planes[len(x)] = np.random.default_rng([seed, len(x)]).standard_normal((tables * bits, len(x)))
                codes.append((((planes[len(x)] @ x) > 0).reshape(tables, bits) @ weights).astype("<i4").tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.list_(pa.int32()))], [*batch.schema.names, "codes"])

    return classes.mapInArrow(run, "digest binary, vec binary, copies long, first_id long, codes array<int>")


def _compare(dtype: str, threshold: float):
    """Compares the rows of one block pair after the other; rows must come sorted by it."""

    def group(rows: dict[str, np.ndarray]) -> tuple[list, list, list] | None:
        vec, side, codes, copies, table = rows["vec"], rows["side"], rows["codes"], rows["copies"], rows["tab"][0]
        x = np.frombuffer(b"".join(vec), dtype).astype("f8").reshape(len(vec), -1)
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        within = len(b) == 0
        right = a if within else b
        found = (x[a] @ x[right].T) / np.outer(norm[a], norm[right]) >= threshold
        i, j = np.nonzero(np.triu(found, 1) if within else found)
        i, j = a[i], right[j]
        if table and len(i):
            grid = np.stack(codes)[:, :table]
            new = np.ones(len(i), bool)
            for k in range(0, len(i), 20_000):
                new[k : k + 20_000] = ~(grid[i[k : k + 20_000]] == grid[j[k : k + 20_000]]).any(1)
            i, j = i[new], j[new]
        if not len(i):
            return None
        links = np.bincount(i, copies[j], len(vec)) + np.bincount(j, copies[i], len(vec))
        least = np.arange(len(vec))
        while True:  # each node takes the least label around it until nothing changes
            was = least.copy()
            np.minimum.at(least, i, least[j])
            np.minimum.at(least, j, least[i])
            least = least[least]
            if (was == least).all():
                break
        hit = np.flatnonzero(links)
        digest = rows["digest"]
        return digest[hit].tolist(), digest[least[hit]].tolist(), links[hit].astype("int64").tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def tasks(t: pa.Table) -> Iterator[pa.RecordBatch]:
            keys = np.stack([t[c].to_numpy() for c in ("dim", "tab", "code", "bi", "bj")], 1)
            edges = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, len(keys)]
            lists = t["codes"].combine_chunks()
            grid = lists.values.to_numpy().reshape(len(lists), -1)
            full = {c: t[c].to_numpy() for c in ("vec", "digest", "side", "copies", "tab")} | {"codes": grid}
            for p, q in zip(edges[:-1], edges[1:], strict=True):
                if q - p > 1 and (got := group({c: v[p:q] for c, v in full.items()})):
                    yield pa.RecordBatch.from_arrays([pa.array(got[0], "binary"), pa.array(got[1], "binary"), pa.array(got[2], "int64")], ["digest", "root", "links"])

        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new]).combine_chunks()
            keys = [held[c].to_numpy() for c in ("dim", "tab", "code", "bi", "bj")]
            last = np.logical_or.reduce([k != k[-1] for k in keys])
            cut = int(last.nonzero()[0][-1]) + 1 if last.any() else 0
            if cut:
                yield from tasks(held.slice(0, cut).combine_chunks())
                held = held.slice(cut)
        if held is not None and len(held):
            yield from tasks(held.combine_chunks())

    return run


def links_and_components(rows: DataFrame, settings: Settings = Settings(), id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links (other vectors with a cosine of at least the threshold), component_id and kept."""
    s = settings
    dtype = "<f4" if isinstance(rows.schema[vec_col].dataType.elementType, T.FloatType) else "<f8"
    made = durable(vectors(rows, id_col, vec_col))
    classes = made.filter("vec is not null").groupBy("digest").agg(
        F.first("vec").alias("vec"), F.count("*").alias("copies"), F.min("vec_id").cast("long").alias("first_id")
    )
    classes = durable(classes.select("digest", "vec", "copies", "first_id"))
    bits, tables = s.shape(classes.count())
    coded = durable(_coded(classes, dtype, bits, tables, s.seed))
    dim = F.octet_length("vec").alias("dim")
    where = coded.select("digest", dim, F.posexplode("codes").alias("tab", "code"))
    sizes = durable(where.groupBy("dim", "tab", "code").agg(F.count("*").alias("n")).filter("n > 1"))
    blocks = F.ceil(F.col("n") / s.block).cast("int")
    placed = where.join(sizes, ["dim", "tab", "code"]).withColumns({"g": blocks, "own": F.pmod(F.xxhash64("digest", "tab"), blocks).cast("int")})
    pairs = placed.select("digest", "dim", "tab", "code", "own", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("other")).select(
        "digest", "dim", "tab", "code", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side")
    )
    wide = pairs.join(coded.select("digest", "vec", "copies", "codes"), "digest")
    key = ["dim", "tab", "code", "bi", "bj"]
    dealt = wide.repartition(*key).sortWithinPartitions(*key)
    found = durable(dealt.mapInArrow(_compare(dtype, s.threshold), "digest binary, root binary, links long"))
    links = found.groupBy("digest").agg(F.sum("links").alias("links"))
    label = connected_components(found.select(F.col("digest").alias("a"), F.col("root").alias("b")))
    joined = classes.select("digest", "copies", "first_id").join(links, "digest", "left").join(label.withColumnRenamed("node", "digest"), "digest", "left")
    joined = durable(joined.withColumn("component", F.coalesce("component", "digest")))
    least = joined.groupBy("component").agg(F.min("first_id").alias("component_id"))
    per_class = durable(joined.join(least, "component").select("digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"))
    return made.select("vec_id", "digest").join(per_class, "digest", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", F.col("vec_id").cast("long")).alias("component_id")
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
