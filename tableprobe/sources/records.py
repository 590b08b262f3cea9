"""Records of text files that may span lines and blocks: read by blocks, in tasks, whatever literals hold.

A file's lines are read as Spark splits them. Where a record begins depends on all text before it, so a first pass tells,
for each block, in which state its text would end and how many records it would end if it began in each state of a lexer:
a small function. The functions of a file's blocks, applied one after the other, give the true state and record number at
each block's beginning, and a second pass cuts records there. A record that crosses blocks is put together from its parts,
the only rows that are shuffled."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Blocks whose states are sent to all tasks, some 100 bytes each; beyond it lines are joined with their block's state.
MOST_BLOCKS = 500_000
#: Files with records that cross blocks that are named in a filter; beyond it all files are read for the parts.
MOST_NAMED = 1000


class Lexer(Protocol):
    """states: in state 0, that of a file's beginning, no record is open."""

    states: int

    def step(self, line: bytes, state: int) -> tuple[int, list[int]]:
        """The state behind the line and its end, and the places in it behind which a record ends."""


class Delimited:
    """Lines of delimited text, in quotes (1) or not (0). A quote opens only where a field begins, and is doubled inside."""

    states = 2

    def __init__(self, sep: str, encoding: str = "utf-8"):
        self.sep = sep.encode(encoding)

    def step(self, line: bytes, state: int) -> tuple[int, list[int]]:
        if b'"' not in line:
            return (0, [len(line)] if line.strip(b"\r") else []) if state == 0 else (1, [])
        at, quoted = 0, state == 1
        while True:
            if quoted:
                at = line.find(b'"', at)
                if at < 0:
                    return 1, []
                if line[at + 1 : at + 2] == b'"':
                    at += 2
                    continue
                quoted = False
            elif line[at : at + 1] == b'"':
                quoted, at = True, at + 1
                continue
            at = line.find(self.sep, at)
            if at < 0:
                return 0, [len(line)]
            at += len(self.sep)


class Statements:
    """Lines of SQL: between statements (0), in one (1), in a string (2, 3), a quoted name (4) or a comment (5, 6: between
    statements). A line comment ends with its line, a backslash in a string also takes a line end."""

    states = 7
    _token = re.compile(rb"['\"`;#]|--|/\*|[^\s]")
    _ends = {2: re.compile(rb"(?:[^'\\]|\\.|'')*'", re.DOTALL), 3: re.compile(rb'(?:[^"\\]|\\.|"")*"', re.DOTALL), 4: re.compile(rb"[^`]*`"), 5: re.compile(rb".*?\*/", re.DOTALL), 6: re.compile(rb".*?\*/", re.DOTALL)}
    _opens = {b"'": 2, b'"': 3, b"`": 4}
    _special = re.compile(rb"['\"`;#*/\-\\]")
    _plain = re.compile(rb"[^'\"`;#/\-]*")

    def step(self, line: bytes, state: int) -> tuple[int, list[int]]:
        at, cuts = 0, []
        if not self._special.search(line):
            return (1 if state == 0 and line.strip() else state), cuts
        while True:
            if state > 1:
                m = self._ends[state].match(line, at)
                if not m:
                    return state, cuts
                at, state = m.end(), 0 if state == 6 else 1
            if state == 1:
                at = self._plain.match(line, at).end()
            m = self._token.search(line, at)
            if not m:
                return state, cuts
            at, mark = m.end(), m[0]
            if mark == b";":
                if state == 1:
                    cuts.append(at)
                state = 0
            elif mark in self._opens:
                state = self._opens[mark]
            elif mark == b"/*":
                state = 5 if state == 1 else 6
            elif mark in (b"#", b"--"):
                return state, cuts
            else:
                state = 1


def lines(spark: SparkSession, paths: list[str], end: str = "\n") -> DataFrame:
    """value (bytes, without the line end), file, block (where it begins) and nth (ascending within a block)."""
    read = spark.read.option("lineSep", end).text(paths)
    return read.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"))


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bool, list[bytes]]]:
    """(file, block and further columns), whether it begins here, and lines, a batch at a time."""
    now = None
    for batch in batches:
        values = batch.column("value").to_pylist()
        keys = list(zip(*(batch.column(c).to_pylist() for c in batch.schema.names[1:]), strict=True))
        at = 0
        while at < len(keys):
            stop = at + 1
            if keys[-1] == keys[at]:
                stop = len(keys)
            while stop < len(keys) and keys[stop] == keys[at]:
                stop += 1
            yield keys[at], keys[at] != now, values[at:stop]
            now, at = keys[at], stop


def functions_of(read: DataFrame, lexer: Lexer) -> DataFrame:
    """file, block, ends (the state behind the block, by the state before it) and n (records that end in it, likewise)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[str, int, list[int], list[int]]] = []
        for (file, block), begins, part in _by_block(batches):
            if begins:
                out.append((file, block, list(range(lexer.states)), [0] * lexer.states))
            _, _, ends, n = out[-1]
            for line in part:
                told = {state: lexer.step(line, state) for state in set(ends)}
                for k, state in enumerate(ends):
                    ends[k], cuts = told[state]
                    n[k] += len(cuts)
        kinds = (pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["file", "block", "ends", "n"])

    return read.select("value", "file", "block").mapInArrow(run, "file string, block long, ends array<int>, n array<long>")


def placed(blocks: DataFrame) -> DataFrame:
    """file, block, state and first (the number of the record that is open or begins there), last and after (state and
    number behind the block), numbers counted in each file."""

    def fold(group: pa.Table) -> pa.Table:
        rows, state, number = sorted(group.to_pylist(), key=lambda r: r["block"]), 0, 0  # a row per block
        for r in rows:
            r["state"], r["first"] = state, number
            state, number = r["ends"][state], number + r["n"][state]
            r["last"], r["after"] = state, number
        kinds = {"file": pa.string(), "block": pa.int64(), "state": pa.int32(), "first": pa.int64(), "last": pa.int32(), "after": pa.int64()}
        return pa.table({c: pa.array([r[c] for r in rows], k) for c, k in kinds.items()})

    return blocks.groupBy("file").applyInArrow(fold, "file string, block long, state int, first long, last int, after long")


def file_starts(states: DataFrame) -> DataFrame:
    """file and start: records of the files before it, by name; one that no end follows counts."""
    sizes = states.groupBy("file").agg((F.max("after") + 1).alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    return sizes.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))


def _cut(lexer: Lexer, known: dict | None):
    """Rows (file, number, part, text) of lines: part is null for a whole record, else the block that the part is from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[str, int, int | None, bytes]] = []
        held, size = [], 0
        file, block, state, number, split = "", 0, 0, 0, False

        def close() -> None:
            """What stays open at a block's end."""
            if any(x.strip() for x in held):
                out.append((file, number, block, b"\n".join(held)))
            held.clear()

        def batch() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary())
            made = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["file", "number", "part", "text"])
            out.clear()
            return made

        for key, begins, part in _by_block(batches):
            if begins:
                close()
                file, block = key[:2]
                state, number = known[file, block] if known is not None else key[2:]
                split = state != 0  # the first record began in an earlier block
            for line in part:
                state, cuts = lexer.step(line, state)
                at = 0
                for cut in cuts:
                    held.append(line[at:cut])
                    out.append((file, number, block if split else None, b"\n".join(held)))
                    size += len(out[-1][3])
                    held.clear()
                    at, number, split = cut, number + 1, False
                if state:
                    held.append(line[at:])
                else:  # blanks and comments
                    held.clear()
            if len(out) >= 10_000 or size > 8_000_000:
                yield batch()
                size = 0
        close()
        yield batch()

    return run


def records(read: DataFrame, lexer: Lexer, states: DataFrame, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """file, number (in its file) and text (bytes; its lines joined by a line feed) of every record of lines(), whose blocks'
    states are given as a table that is written or small. What follows a file's last end is a record if it isn't blank."""
    schema = "file string, number long, part long, text binary"
    if states.count() <= most_blocks:
        known = {(r["file"], r["block"]): (r["state"], r["first"]) for r in states.collect()}  # most_blocks rows
        shared = read.sparkSession.sparkContext.broadcast(known)
        rows = lambda df: df.select("value", "file", "block").mapInArrow(lambda batches: _cut(lexer, shared.value)(batches), schema)
    else:
        joined = lambda df: df.join(states.select("file", "block", "state", "first"), ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "nth")
        rows = lambda df: joined(df).select("value", "file", "block", "state", "first").mapInArrow(_cut(lexer, None), schema)
    whole = rows(read).filter("part is null").select("file", "number", "text")
    some = [r["file"] for r in states.filter("last <> 0").select("file").distinct().limit(MOST_NAMED + 1).collect()]
    if not some:
        return whole
    # Files with records that cross blocks, or have no end, are read again, for their parts.
    of = read if len(some) > MOST_NAMED else read.filter(F.col("file").isin(some))
    parts = rows(of).filter("part is not null").groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("part", "text"))).alias("p"))  # of one record
    return whole.unionByName(parts.select("file", "number", F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["text"])), "0A")).alias("text")))
