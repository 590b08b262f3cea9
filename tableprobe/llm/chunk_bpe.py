"""BPE encoding by content-defined chunk reuse, and decoding.

A rolling hash over 32 bytes cuts texts where their content says so; a cut moves on to the next gap between
words. Documents are first dealt by their least chunk fingerprint (``rebalance``, so that a hot group is
split over tasks), which brings documents that share chunks together; there each distinct chunk is encoded
once while the table of chunks, of bounded size, holds it. Joins are then repaired: the last word before a
join and the first one after it are encoded together; where that differs from what the two chunks say, the
chunks are merged and encoded anew, until both sides of every join agree exactly.

Defined cases: a null text is an empty one and has no ids; the special token's string in a text becomes the
special token, as with the tokenizer's own defaults; a text without gaps is one chunk; repeated rows give
repeated rows; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprobe.llm.common import schema_of
from tableprobe.llm.tokens import sliced

WINDOW = 32
#: A cut is taken where the rolling hash has this many zero bits: chunks of about 512 bytes.
CUT_BITS = 9
TABLE_CHARS = 10_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = np.uint64(0xD6E8FEB86659FD93)


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    up, down = np.full(n, _BASE, "uint64"), np.full(n, inverse, "uint64")
    up[0] = down[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mixed polynomial hashes of the byte spans, from prefix sums of byte times power."""
    _, down = _powers(1 << (len(prefix) - 1).bit_length())
    with np.errstate(over="ignore"):
        h = (prefix[ends] - prefix[starts]) * down[starts]
        h ^= (ends - starts).astype("uint64") * _MIX
        h = (h ^ (h >> np.uint64(32))) * _MIX
        return h ^ (h >> np.uint64(29))


def _prefix(data: np.ndarray) -> np.ndarray:
    up, _ = _powers(1 << len(data).bit_length())
    with np.errstate(over="ignore"):
        return np.r_[np.uint64(0), np.cumsum((data.astype("uint64") + np.uint64(1)) * up[: len(data)])]


def cuts(data: bytes, cut_bits: int = CUT_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Chunk bounds in a UTF-8 text, its ends included, and a fingerprint per chunk.

    Cuts stand between a printable ASCII character and a space or line feed, where no word goes on."""
    raw = np.frombuffer(data, "uint8")
    if not len(raw):
        return np.zeros(1, "int64"), np.zeros(0, "uint64")
    prefix = _prefix(raw)
    bounds = np.array([0, len(raw)])
    if len(raw) > WINDOW:
        at = np.arange(WINDOW, len(raw))
        rolling = _span_hashes(prefix, at - WINDOW, at)
        hits = at[(rolling & np.uint64((1 << cut_bits) - 1)) == 0]
        gap = (raw == 0x20) | (raw == 0x0A)
        safe = np.flatnonzero(gap[1:] & (raw[:-1] > 0x20) & (raw[:-1] < 0x7F)) + 1
        moved = np.searchsorted(safe, hits)
        bounds = np.unique(np.r_[0, safe[moved[moved < len(safe)]], len(raw)])
    return bounds, _span_hashes(prefix, bounds[:-1], bounds[1:])


class ChunkEncoder:
    """Encodes texts with a table of chunks; one per worker process."""

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        with open(json_path, encoding="utf-8") as f:
            self.special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("chunks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=self.special)
        self.allowed = set(self.special)
        #: Chunk: ids (little-endian unsigned 32-bit), first word and last word.
        self.table: dict[bytes, tuple[bytes, bytes, bytes]] = {}
        self.joins: dict[tuple[bytes, bytes], bool] = {}
        self.held = self.encoded = self.reused = self.repaired = 0

    def plain(self, text: str) -> bytes:
        return np.array(self.bpe.encode(text, allowed_special=self.allowed), "<u4").tobytes()

    def text(self, ids: bytes) -> str:
        """What ids spell; bytes that are no UTF-8 become replacement characters."""
        return self.bpe.decode_bytes(np.frombuffer(ids, "<u4").tolist()).decode("utf-8", "replace")

    def chunk(self, data: bytes) -> tuple[bytes, bytes, bytes]:
        found = self.table.get(data)
        if found is None:
            gaps = [k for k in (data.find(b" ", 1), data.find(b"\n", 1)) if k > 0]
            head = data[: min(gaps)] if gaps else data
            tail = data[max(data.rfind(b" "), data.rfind(b"\n"), 0) :]
            if tail.strip() == b"":
                tail = data
            found = self.table[data] = (self.plain(data.decode()), head, tail)
            self.held += len(data)
            self.encoded += 1
        else:
            self.reused += 1
        return found

    def agree(self, left: tuple, right: tuple) -> bool:
        """Do the words at the join, encoded together, say what the two chunks say?"""
        tail, head = left[2], right[1]
        found = self.joins.get((tail, head))
        if found is None:
            a, b = self.plain(tail.decode()), self.plain(head.decode())
            found = self.plain((tail + head).decode()) == a + b and left[0].endswith(a) and right[0].startswith(b)
            self.joins[tail, head] = found
        return found

    def encode(self, text: str) -> bytes:
        data = text.encode()
        bounds, _ = cuts(data)
        parts: list[tuple[bytes, tuple]] = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            new = data[a:b]
            got = self.chunk(new)
            while parts and not self.agree(parts[-1][1], got):
                new = parts.pop()[0] + new
                got = self.chunk(new)
                self.repaired += 1
            parts.append((new, got))
        return b"".join(got[0] for _, got in parts)

    def trim(self) -> None:
        if self.held > TABLE_CHARS or len(self.joins) > 60_000:
            self.table.clear()
            self.joins.clear()
            self.held = 0


@functools.cache
def chunk_encoder(json_path: str, ranks_path: str, pattern: str) -> ChunkEncoder:
    return ChunkEncoder(json_path, ranks_path, pattern)


def _routed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and the least chunk fingerprint, dealt by that fingerprint."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.compute.fill_null(batch.column(1), "")
            route = [int(f.min() >> np.uint64(1)) if len(f) else 0 for f in (cuts(x.as_py().encode())[1] for x in texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), texts, pa.array(route, "int64")], ["id", "text", "route"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {kind}, text string, route long").hint("rebalance", "route")


def encode(docs: DataFrame, json_path: str, ranks_path: str, pattern: str, decoded: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit) of every whole text; with ``decoded`` also
    decoded, what the tokenizer makes of the ids, in the same worker."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunk_encoder(json_path, ranks_path, pattern)
        for batch in batches:
            at = 0
            for part in sliced(x.as_py() for x in batch.column(1)):
                ids = [encoder.encode(x) for x in part]
                encoder.trim()
                n = pa.array([len(x) // 4 for x in ids], "int64")
                columns = {"doc_id": batch.column(0).slice(at, len(part)), "n_tokens": n, "ids": pa.array(ids, "binary")}
                if decoded:
                    columns["decoded"] = pa.array([encoder.text(x) for x in ids], "string")
                at += len(part)
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return _routed(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary" + ", decoded string" * decoded)


def decode(encoded: DataFrame, json_path: str, ranks_path: str, pattern: str) -> DataFrame:
    """encoded (with a binary column ids) and text, as the tokenizer decodes it, special tokens kept."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = chunk_encoder(json_path, ranks_path, pattern).text
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([text(x.as_py() or b"") for x in batch.column(place)], "string")], [*batch.schema.names, "text"])

    place, plain = encoded.columns.index("ids"), encoded.toDF(*[f"c{k}" for k in range(len(encoded.columns))])  # names of any kind
    return plain.mapInArrow(run, f"{schema_of(plain)}, text string").toDF(*encoded.columns, "text")
