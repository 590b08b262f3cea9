"""Codes for vectors by product quantisation, its codebooks learned by Lloyd rounds over resident members.

A component x counts as the integer floor(scale * x); a vector is cut into equal consecutive parts, and each part
position has a codebook of its own. Parts are dealt once, by (position, entry, salt), to the files of their owners. In
a round an owner sums its resident members, the sums of an entry's owners make its new value, and with the new codebooks
(``parts`` times ``entries`` small vectors, a size fixed by parameters) each owner finds the members that are now nearer
to another entry: those alone are shuffled, to the owners of that entry, all others stay where they are. The salt is a
place in the input, not a property of the vector, so that an entry with most of the members has many owners.

All arithmetic is exact: in doubles where every product is an integer below 2 ** 53, else in Python's integers.

Defined cases: a vector that is null, empty, or holds a null, NaN or infinite component is left out, and so is one of
another length than that of the least vec_id's vector (a null id counts as the greatest; of equal ids, the lesser vector
first); parts of a length that does not divide differ by one component; fewer vectors than entries make smaller codebooks,
equal vectors equal entries, of which the first is used; a null id or label stays null; repeated rows are rows like any
other; an empty table gives no rows; an error of 2 ** 63 and more is null; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableprobe.llm.common import discard, durable, run_dir, saved, schema_of

#: The entries of each part position, in order: integers, one list an entry.
Codebooks = list[list[list[int]]]


@dataclass(frozen=True)
class Settings:
    parts: int = 8
    entries: int = 16
    rounds: int = 6
    scale: int = 4096
    #: Owners of an entry: members are dealt to so many at least, and to one more for each owner_members of all parts.
    least_owners: int = 16
    owner_members: int = 1_000_000


def _usable(c: Column) -> Column:
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return c.isNotNull() & (F.size(c) > 0) & ~F.coalesce(bad, F.lit(True))


def _integers(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of each component: doubles where they and all sums of their squares are exact, else Python's integers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(vectors * float(scale))
    if float(np.abs(scaled).max(initial=0.0)) <= _largest(vectors.shape[1]) and scale & (scale - 1) == 0:
        return scaled
    exact = [[_floor(float(x), scale) for x in row] for row in vectors]
    return np.array(exact, object).reshape(vectors.shape)


def _floor(x: float, scale: int) -> int:
    above, below = x.as_integer_ratio()
    return above * scale // below


def _largest(width: int) -> float:
    """Components up to this size give squared distances below 2 ** 53 over so many components."""
    return float(int((2**53 / (4 * max(1, width))) ** 0.5) - 1)


def _nearest(own: np.ndarray, entries: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row, the first of equals, and its squared distance."""
    book = np.array(entries, object).reshape(len(entries), own.shape[1])
    if own.dtype != object and max((abs(x) for e in entries for x in e), default=0) <= _largest(own.shape[1]):
        book = book.astype(float)
    else:
        own = np.array([[int(x) for x in row] for row in own], object).reshape(own.shape)
    distance = np.stack([((own - e) ** 2).sum(1) for e in book], 1)
    at = distance.argmin(1) if distance.dtype != object else np.array([int(row.tolist().index(min(row))) for row in distance], "int64")
    return at, distance[np.arange(len(at)), at]


def _bounds(width: int, parts: int) -> list[int]:
    return [k * width // parts for k in range(parts + 1)]


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column, all of one length and without nulls."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], "int32"), pa.array(rows.ravel()))


def usable(vectors: DataFrame, s: Settings, id_col: str, vec_col: str, *others: str) -> tuple[DataFrame, Codebooks]:
    """The rows that take part (id, vec, and the other columns under names of their own), and the first codebooks."""
    named = [F.col(f"`{c}`").alias(f"o{k}") for k, c in enumerate(others)]
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec"), *named).filter(_usable(F.col("vec")))
    first = rows.select("id", "vec").orderBy(F.col("id").asc_nulls_last(), "vec").limit(1).collect()
    if not first:
        return rows, [[] for _ in range(s.parts)]
    width = len(first[0]["vec"])
    rows = rows.filter(F.size("vec") == width)
    start = rows.select("id", "vec").orderBy(F.col("id").asc_nulls_last(), "vec").limit(s.entries).collect()  # as many rows as entries
    cut = _bounds(width, s.parts)
    whole = [[_floor(x, s.scale) for x in r["vec"]] for r in start]
    return rows, [[v[p:q] for v in whole] for p, q in zip(cut[:-1], cut[1:], strict=True)]


_MEMBER = "pos int, entry int, salt int, part array<double>"


def _dealt(rows: DataFrame, books: Codebooks, s: Settings, owners: int) -> DataFrame:
    """The parts of all rows, with their nearest entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId() * 7919
        for batch in batches:
            x = _matrix(batch.column(0))
            cut, n = _bounds(x.shape[1], s.parts), len(x)
            salts = pa.array((salt + np.arange(n)) % owners, "int32")
            salt += n
            for pos in range(s.parts if n else 0):
                own = x[:, cut[pos] : cut[pos + 1]]
                at, _ = _nearest(_integers(own, s.scale), books[pos])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, pos, "int32")), pa.array(at.astype("int32")), salts, _lists(own)], ["pos", "entry", "salt", "part"])

    return rows.select("vec").mapInArrow(run, _MEMBER)


def _owned(members: DataFrame) -> DataFrame:
    """Members at their owners, those of an entry together."""
    return members.select("pos", "entry", "salt", "part").repartition("pos", "entry", "salt").sortWithinPartitions("pos", "entry")


def _moved(members: DataFrame, books: Codebooks, s: Settings) -> DataFrame:
    """Members with their nearest entries, and whether that is another than before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entry = batch.column("entry").to_numpy()
            after = entry.copy()
            for _, rows, own in _by_position(batch):
                after[rows], _ = _nearest(_integers(own, s.scale), books[int(batch.column("pos")[rows[0]].as_py())])
            yield pa.RecordBatch.from_arrays([batch.column("pos"), pa.array(after, "int32"), batch.column("salt"), batch.column("part"), pa.array(after != entry)], ["pos", "entry", "salt", "part", "moved"])

    return members.select("pos", "entry", "salt", "part").mapInArrow(run, f"{_MEMBER}, moved boolean")


def _by_position(batch: pa.RecordBatch, *more: str) -> Iterator[tuple[tuple[int, ...], np.ndarray, np.ndarray]]:
    """Values of pos (and more columns), the places of the rows that have them, and their parts."""
    keys = np.stack([batch.column(c).to_numpy() for c in ("pos", *more)], 1)
    if len(keys):
        found, of = np.unique(keys, axis=0, return_inverse=True)
        for k, key in enumerate(found):
            rows = np.flatnonzero(of.ravel() == k)
            yield tuple(key.tolist()), rows, _matrix(batch.column("part").take(pa.array(rows)))


def _sums(members: DataFrame, s: Settings) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(position, entry): members and their sums. Each task sums what it holds; an entry's sums then meet, one a task."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, ...], tuple[int, np.ndarray]] = {}
        for batch in batches:
            for key, rows, own in _by_position(batch, "entry"):
                whole = _integers(own, s.scale)
                n, total = held.get(key, (0, 0))
                held[key] = n + len(rows), total + np.array([int(x) for x in whole.sum(0)], object)
        columns = [[k[0] for k in held], [k[1] for k in held], [n for n, _ in held.values()], [[str(x) for x in t] for _, t in held.values()]]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["pos", "entry", "n", "total"])

    def whole(group: pa.Table) -> pa.Table:
        totals = [sum(map(int, column)) for column in zip(*group["total"].to_pylist(), strict=True)]
        row = {"pos": group["pos"][:1], "entry": group["entry"][:1], "n": pa.array([sum(group["n"].to_pylist())]), "total": pa.array([list(map(str, totals))], pa.list_(pa.string()))}
        return pa.table(row)

    schema = "pos int, entry int, n long, total array<string>"
    found = members.select("pos", "entry", "part").mapInArrow(partial, schema).groupBy("pos", "entry").applyInArrow(whole, schema)
    return {(r["pos"], r["entry"]): (r["n"], list(map(int, r["total"]))) for r in found.collect()}  # parts times entries rows


def train(rows: DataFrame, books: Codebooks, s: Settings = Settings()) -> Codebooks:
    """The codebooks after all rounds, of what usable() gives. What a round leaves behind is deleted."""
    if not any(books):
        return books
    spark = rows.sparkSession
    owners = max(s.least_owners, -(-rows.count() * s.parts // s.owner_members))
    resident = [saved(_owned(_dealt(rows, books, s, owners)))]
    for k in range(s.rounds):
        members = spark.read.schema(_MEMBER).parquet(*resident)
        sums = _sums(members, s)
        books = [[[t // sums[p, e][0] for t in sums[p, e][1]] if (p, e) in sums else entry for e, entry in enumerate(book)] for p, book in enumerate(books)]
        if k + 1 < s.rounds:
            was, split = resident, run_dir(spark, "lloyd")
            _moved(members, books, s).write.partitionBy("moved").parquet(split)
            both = spark.read.schema(f"{_MEMBER}, moved boolean").parquet(split)
            migrated = saved(_owned(both.filter("moved")))
            resident = [*([f"{split}/moved=false"] if both.filter("not moved").head(1) else []), migrated]
            discard(spark, *was, f"{split}/moved=true")
    discard(spark, *resident)
    return books


def codebooks_text(books: Codebooks) -> str:
    """All components in decimal, by part, entry and place, joined by commas."""
    return ",".join(str(x) for book in books for entry in book for x in entry)


def encode(rows: DataFrame, books: Codebooks, s: Settings = Settings()) -> DataFrame:
    """rows with code (two hex digits a part) and error in place of the vector."""
    others = [c for c in rows.columns if c != "vec"]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vec"))
            cut, n = _bounds(x.shape[1], s.parts), len(x)
            at, error = np.zeros((n, s.parts), "uint8"), [0] * n
            for pos in range(s.parts if n else 0):
                at[:, pos], distance = _nearest(_integers(x[:, cut[pos] : cut[pos + 1]], s.scale), books[pos])
                error = [a + int(b) for a, b in zip(error, distance, strict=True)]
            code = [row.tobytes().hex() for row in at]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(code, "string"), pa.array([e if e < 1 << 63 else None for e in error], "int64")], [*others, "code", "error"])

    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in others) + ", code string, error long")


def compress(vectors: DataFrame, s: Settings = Settings(), id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code, error, label_error (of all rows with an equal label; null labels are equal) and codebooks_sha256."""
    if not 0 < s.entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    rows, books = usable(vectors, s, id_col, vec_col, label_col)
    books = train(rows, books, s)
    coded = durable(encode(rows, books, s))
    total = coded.groupBy(F.col("o0").alias("l")).agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("bigint").alias("label_error"))
    found = coded.join(total, F.col("o0").eqNullSafe(F.col("l")))
    sha = hashlib.sha256(codebooks_text(books).encode()).hexdigest()
    return found.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def decode(coded: DataFrame, books: Codebooks, s: Settings = Settings()) -> DataFrame:
    """coded with vec, the centres that its codes name, in the vectors' own scale."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [bytes.fromhex(c) if c is not None else None for c in batch.column(place).to_pylist()]
            vecs = [None if c is None else [x / s.scale for book, e in zip(books, c, strict=True) for x in book[e]] for c in codes]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vecs, pa.list_(pa.float64()))], [*batch.schema.names, "vec"])

    place, plain = coded.columns.index("code"), coded.toDF(*[f"c{k}" for k in range(len(coded.columns))])  # names of any kind
    return plain.mapInArrow(run, f"{schema_of(plain)}, vec array<double>").toDF(*coded.columns, "vec")

