"""Packing of documents beside their lexical neighbours, found by BM25 in a sharded inverted index.

Terms are token ids, so that document frequencies are a table of the vocabulary's size, counted over all documents. A
document is dealt by two terms drawn from it by an exponential race that favours heavy terms: documents draw the same
term the more often the more of their weight they share. In that order they are dealt by range, and a task's documents
make index shards of bounded size, each with postings of all terms of whole documents. Within a shard a seed fills its
window with its best neighbours that are still unused and fit; the best one that doesn't fit is cut, and its rest is the
next seed. A document longer than a window fills windows of its own first. A window that a shard leaves open goes on in
the next one; the last of a task is cut into sequences whose lengths are powers of two, which need no padding.

Defined cases: a null text is an empty one and holds the end token only; a null doc_id stays null; repeated rows are
packed each; an empty table gives no rows; a document of any length is indexed whole; other columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprobe.llm.common import durable
from tableprobe.llm.tokens import byte_encoder, release

_OUT = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@dataclass(frozen=True)
class Settings:
    window: int = 1024
    end_id: int = 0
    #: BM25: saturation of term frequency, and how much length counts.
    k1: float = 1.2
    b: float = 0.75
    #: Documents of an index shard, and tokens.
    shard_rows: int = 512
    shard_tokens: int = 1_000_000
    #: Neighbours that are tried whole before one is cut.
    tried: int = 16


@dataclass(frozen=True)
class Statistics:
    """Of all documents: weights of terms, and their mean number of tokens."""

    idf: np.ndarray
    mean_length: float


def encoded(docs: DataFrame, json_path: str, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row (any number of its own), n and ids (little-endian; of 16 bits where the vocabulary allows, else of 32) of
    every text, without the end token."""
    kind, width = docs.schema[id_col].dataType.simpleString(), _width(byte_encoder(json_path, ranks_path, pattern).size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_encoder(json_path, ranks_path, pattern)
        for batch in batches:
            at, held, ids, count = 0, 0, [], []
            for k, text in enumerate(batch.column(1), 1):
                ids.append(encode(text.as_py()).astype(width).tobytes())
                count.append(len(ids[-1]) // np.dtype(width).itemsize)
                held += len(ids[-1])
                if held > 8_000_000 or k == batch.num_rows:
                    made = [batch.column(0).slice(at, k - at), pa.array(count, "int64"), pa.array(ids, "binary")]
                    yield pa.RecordBatch.from_arrays(made, ["doc_id", "n", "ids"])
                    at, held, ids, count = k, 0, [], []
        release()

    made = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(run, f"doc_id {kind}, n long, ids binary")
    return made.withColumn("row", F.monotonically_increasing_id())


def _width(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def _read(column: pa.Array, size: int) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), _width(size)) for x in column]


def _terms(ids: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents by place, and the distinct terms of each, ascending, with how often it has them."""
    kind = "uint32" if len(ids) * size < 1 << 32 else "uint64"
    both = np.concatenate([*ids, np.zeros(0, "u2")]).astype(kind)
    both += np.repeat(np.arange(len(ids), dtype=kind) * np.array(size, kind), [len(x) for x in ids])
    both.sort()
    first = np.flatnonzero(np.r_[len(both) > 0, both[1:] != both[:-1]])
    doc, term = np.divmod(both[first], np.array(size, kind))
    return doc.astype("int64"), term.astype("int64"), np.diff(np.r_[first, len(both)])


def statistics(docs: DataFrame, size: int) -> Statistics:
    """Over what encoded() gives, of a vocabulary of so many ids."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows, total = np.zeros(size, "int64"), 0, 0
        for batch in batches:
            ids = _read(batch.column(0), size)
            df += np.bincount(_terms(ids, size)[1], minlength=size)
            rows, total = rows + len(ids), total + sum(map(len, ids))
        term = np.flatnonzero(df)
        # Under -1 and -2: documents, and tokens of all.
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[term, -1, -2]), pa.array(np.r_[df[term], rows, total])], ["term", "n"])

    found = docs.select("ids").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    told = {r["term"]: r["n"] for r in found.collect()}  # as many rows as the vocabulary
    rows = told.pop(-1, 0)
    total, df = told.pop(-2, 0), np.zeros(size)
    df[list(told)] = list(told.values())
    return Statistics(np.log1p((rows - df + 0.5) / (df + 0.5)).astype("f4"), max(total, 1) / max(rows, 1))


def _weights(ids: list[np.ndarray], stats: Statistics, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, terms, and what BM25 gives a document for a term."""
    doc, term, tf = _terms(ids, len(stats.idf))
    length = np.array([len(x) for x in ids], float)[doc]
    return doc, term, stats.idf[term] * tf * (s.k1 + 1) / (tf + s.k1 * (1 - s.b + s.b * length / stats.mean_length))


def _drawn(doc: np.ndarray, term: np.ndarray, weight: np.ndarray, race: np.ndarray, rows: int) -> np.ndarray:
    """The term of each document whose time in the race, divided by its weight, is least; -1 without terms."""
    out = np.full(rows, -1, "int32")
    if len(doc):
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        time = race[term] / np.maximum(weight, 1e-9)
        least = np.repeat(np.minimum.reduceat(time, first), np.diff(np.r_[first, len(doc)]))
        hit = np.flatnonzero(time == least)[::-1]
        out[doc[hit]] = term[hit]  # of equals, the first
    return out


class Shard:
    """The inverted index of some documents."""

    def __init__(self, ids: list[np.ndarray], stats: Statistics, s: Settings):
        doc, term, weight = _weights(ids, stats, s)
        self.rows, self.size = len(ids), len(stats.idf)
        self.first = np.searchsorted(doc, np.arange(len(ids) + 1))
        order = np.argsort(term.astype("u4"), kind="stable")
        terms, at, n = np.unique(term[order], return_index=True, return_counts=True)
        self.begin = np.zeros(self.size + 1, "int64")
        self.begin[terms + 1] = n
        np.cumsum(self.begin, out=self.begin)
        self.term, self.doc, self.weight = term, doc[order], weight[order]
        # Postings of terms that many documents have are rows of a matrix.
        often = np.flatnonzero(8 * n >= self.rows)
        self.row = np.full(self.size, -1, "int32")
        self.row[terms[often]] = np.arange(len(often))
        self.matrix = np.zeros((len(often), self.rows))
        here = np.flatnonzero(self.row[term[order]] >= 0)
        self.matrix[self.row[term[order[here]]], self.doc[here]] = self.weight[here]

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document for the seed's terms."""
        terms = self.term[self.first[seed] : self.first[seed + 1]]
        row = self.row[terms]
        rare = terms[row < 0]
        begin, n = self.begin[rare], self.begin[rare + 1] - self.begin[rare]
        at = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        return np.bincount(self.doc[at], self.weight[at], self.rows) + self.matrix[row[row >= 0]].sum(0)


class Filler:
    """Fills windows from shard to shard; ``placed`` has document, start, length, sequence and offset of each piece."""

    def __init__(self, s: Settings):
        self.s, self.room, self.sequence = s, s.window, 0
        self.open: list[tuple[int, int, int]] = []  # document, start, length: the pieces of the open window
        self.placed: list[tuple[int, int, int, int, int]] = []

    def _close(self) -> None:
        at = 0
        for doc, start, n in self.open:
            self.placed.append((doc, start, n, self.sequence, at))
            at += n
        self.open, self.room, self.sequence = [], self.s.window, self.sequence + 1

    def _put(self, doc: int, start: int, n: int) -> None:
        while n:
            part = min(n, self.room)
            self.open.append((doc, start, part))
            self.room -= part
            start, n = start + part, n - part
            if not self.room:
                self._close()

    def shard(self, first: int, lengths: list[int], index: Shard) -> None:
        """All documents of a shard, numbered from first on."""
        unused = np.ones(len(lengths), bool)
        size = np.array(lengths)
        for lead in range(len(lengths)):
            seed = lead if unused[lead] else -1
            while seed >= 0:
                unused[seed] = False
                self._put(first + seed, 0, lengths[seed])
                seed = self._neighbours(first, seed, size, unused, index)

    def _neighbours(self, first: int, seed: int, size: np.ndarray, unused: np.ndarray, index: Shard) -> int:
        """Fills what is open of the window with unused neighbours of the seed that fit; the best of the others, which is
        to be cut, is the next seed. -1 where the window is full or there is no other."""
        if self.room == self.s.window or not unused.any():
            return -1
        score = np.where(unused, index.scores(seed), 0)
        best = np.argsort(-score, kind="stable")[: self.s.tried]
        for k in best[score[best] > 0].tolist():
            if size[k] <= self.room:
                unused[k] = False
                self._put(first + k, 0, int(size[k]))
                if self.room == self.s.window:
                    return -1
        left = np.flatnonzero(unused & (score > 0))
        return int(left[score[left].argmax()]) if len(left) else -1

    def finish(self) -> None:
        """Cuts the window that is open into sequences whose lengths are powers of two."""
        pieces, n = self.open, self.s.window - self.room
        self.open = []
        while n:
            self.room = 1 << (n.bit_length() - 1)
            n -= self.room
            while self.room:
                doc, start, length = pieces[0]
                part = min(length, self.room)
                self.open.append((doc, start, part))
                self.room -= part
                pieces = [(doc, start + part, length - part), *pieces[1:]] if part < length else pieces[1:]
            self._close()


def pack(docs: DataFrame, size: int, s: Settings = Settings()) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece, of what encoded() gives."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    stats = statistics(docs, size)
    shared = docs.sparkSession.sparkContext.broadcast((stats, np.random.default_rng(7).exponential(size=(2, size)).astype("f4")))  # the vocabulary's size

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stats, races = shared.value
        for batch in batches:
            doc, term, weight = _weights(_read(batch.column("ids"), size), stats, s)
            draws = [pa.array(_drawn(doc, term, weight, race, batch.num_rows)) for race in races]
            yield pa.RecordBatch.from_arrays([*batch.columns, *draws], [*batch.schema.names, "x", "y"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stats, _ = shared.value
        filler, ids, keys, base = Filler(s), [], [], 0
        top = TaskContext.get().partitionId() << 40
        waiting: dict[int, tuple[np.ndarray, pa.Array]] = {}  # documents with pieces that are not out yet

        def ready(last: bool) -> pa.RecordBatch:
            nonlocal base
            for k, (own, key) in enumerate(zip(ids, keys, strict=True)):
                waiting[base + k] = own, key
            if ids:
                filler.shard(base, [len(x) + 1 for x in ids], Shard(ids, stats, s))
            base += len(ids)
            ids.clear()
            keys.clear()
            if last:
                filler.finish()
            out: dict[str, list[int]] = {c: [] for c in _OUT}
            named = []
            for doc, start, n, sequence, offset in filler.placed:
                own, key = waiting[doc]
                part = own[start : start + n].astype("<u4").tobytes()
                if start + n > len(own):
                    part += np.array([s.end_id], "<u4").tobytes()
                named.append(key)
                for c, x in zip(_OUT, (start, n, zlib.crc32(part), len(own) + 1, top + sequence, offset), strict=True):
                    out[c].append(x)
            filler.placed.clear()
            still = {doc for doc, _, _ in filler.open}
            for doc in [d for d in waiting if d not in still]:
                del waiting[doc]
            return pa.RecordBatch.from_arrays([pa.array([k.as_py() for k in named], key_type), *(pa.array(out[c], "int64") for c in _OUT)], ["doc_id", *_OUT])

        key_type, tokens = None, 0
        for batch in batches:
            key_type = batch.schema.field("doc_id").type
            for key, own in zip(batch.column("doc_id"), _read(batch.column("ids"), size), strict=True):
                keys.append(key)
                ids.append(own)
                tokens += len(ids[-1])
                if len(ids) >= s.shard_rows or tokens >= s.shard_tokens:
                    yield ready(False)
                    tokens = 0
        if key_type is not None:
            yield ready(True)
        release()

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    routed = docs.mapInArrow(route, ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", x int, y int")
    dealt = routed.repartitionByRange("x", "y", "row").sortWithinPartitions("x", "y", "row")
    return dealt.select("doc_id", "ids").mapInArrow(fill, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in _OUT))


def lexical_packing(docs: DataFrame, json_path: str, ranks_path: str, pattern: str, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents, encoded by a byte-level BPE, in sequences of at most ``window`` tokens."""
    return pack(durable(encoded(docs, json_path, ranks_path, pattern, id_col, text_col)), byte_encoder(json_path, ranks_path, pattern).size, s)
