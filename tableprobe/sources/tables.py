"""Sources: delimited text, SQL dumps, tables that exist already; one error type for what cannot be read."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tableprobe.functions.values import is_empty
from tableprobe.sources import records

# Delimiters by extension, the size of the head that tells an encoding, and the fallback encoding.
DELIMITERS = {".csv": ",", ".tsv": "\t", ".tab": "\t"}
CANDIDATES = (",", "\t", ";", "|")
HEAD_BYTES = 64 * 1024
FALLBACK = "windows-1252"


class SourceError(ValueError):
    """cause: empty-file, unsupported-extension, no-header, no-columns or unreadable."""

    def __init__(self, cause: str, message: str):
        super().__init__(message)
        self.cause = cause


def unique_headers(raw: list[str]) -> list[str]:
    """Trimmed names; blank ones are numbered by place, repeated ones by occurrence."""
    out: list[str] = []
    seen: dict[str, int] = {}
    for i, name in enumerate(raw):
        name = (name or "").strip() or f"column_{i + 1}"
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return out


def detect_encoding(head: bytes) -> str:
    """UTF-8 if the head decodes strictly (a character cut off at its end is no fault), else windows-1252."""
    try:
        head[:HEAD_BYTES].decode("utf-8")
    except UnicodeDecodeError as e:
        if not (len(head) >= HEAD_BYTES and e.reason == "unexpected end of data"):
            return FALLBACK
    return "utf-8"


def detect_delimiter(line: str) -> str:
    """The candidate that is most frequent outside quotes; a comma for none."""
    bare = re.sub(r'"[^"]*"', "", line)
    return max(CANDIDATES, key=lambda c: (bare.count(c), c == ","))


@dataclass(frozen=True)
class Head:
    """How a file is written, by its first bytes. end: what ends its lines, before which a carriage return may stand."""

    encoding: str
    sep: str
    end: str
    names: tuple[str, ...]


def _files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Paths and sizes of the files of a path, by name; what Spark does not read (names with _ or . first) is left out."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    system, found = p.getFileSystem(spark._jsc.hadoopConfiguration()), []
    for top in system.globStatus(p) or ():
        some = system.listStatus(top.getPath()) if top.isDirectory() else [top]
        found += [(x.getPath().toString(), x.getLen()) for x in some if not x.isDirectory() and not (top.isDirectory() and x.getPath().getName().startswith(("_", ".")))]
    if not found:
        raise SourceError("unreadable", f"no such file: {path}")
    return sorted(found)


def _head(spark: SparkSession, path: str) -> bytes:
    """The first bytes of one file, by Hadoop's file system, wherever the path lies; of what it holds, if it is compressed."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(conf).open(p)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(p)
        return bytes((codec.createInputStream(stream) if codec else stream).readNBytes(HEAD_BYTES))
    finally:
        stream.close()


def describe_head(head: bytes, name: str, delimiter: str | None = None, encoding: str | None = None) -> Head:
    """A file's encoding, delimiter and header; the header may hold line ends in quotes."""
    encoding = encoding or detect_encoding(head)
    text = head.decode(encoding, "replace").removeprefix("\ufeff")
    suffix = re.search(r"(\.\w+)(\.gz|\.bz2)?$", name)
    sep = delimiter or DELIMITERS.get(suffix[1].lower() if suffix else "") or detect_delimiter(text.splitlines()[0])
    end = "\r" if "\r" in text and "\n" not in text else "\n"
    return Head(encoding, sep, end, tuple(unique_headers(next(csv.reader(io.StringIO(text, newline=""), delimiter=sep), []))))


def heads(spark: SparkSession, path: str, delimiter: str | None = None, encoding: str | None = None) -> dict[Head, list[str]]:
    """The files of a path that aren't blank, by how they are written, in the order of their names."""
    files = [f for f, size in _files(spark, path) if size]
    with ThreadPoolExecutor(16) as pool:
        found = list(pool.map(lambda f: _head(spark, f), files))
    out: dict[Head, list[str]] = {}
    for file, head in zip(files, found, strict=True):
        if head.strip():
            out.setdefault(describe_head(head, file, delimiter, encoding), []).append(file)
    return out


#: Encodings in which quotes, delimiters and line ends are the bytes of ASCII, so that files can be cut into lines as bytes.
_BYTEWISE = ("utf-8", FALLBACK, "iso-8859-1", "us-ascii")


def read_delimited(spark: SparkSession, path: str, delimiter: str | None = None, multi_line: bool = False, encoding: str | None = None, row_id: str | None = None) -> DataFrame:
    """All-text table of a delimited file or folder: names made unique, blank rows dropped, missing cells ''. Each file of
    a folder has its own encoding, delimiter and header; columns meet by name, those of the first file first.
    row_id names a column to add, of row numbers from 0 in the order of the source, blank rows counted, empty lines not.

    Files with line ends inside quotes need multi_line, which reads each file twice, by blocks, in as many tasks."""
    groups = heads(spark, path, delimiter, encoding)
    if not groups:
        raise SourceError("empty-file", f"{path} is empty")
    names = list(dict.fromkeys(n for head in groups for n in head.names))
    if not names:
        raise SourceError("no-header", f"{path} has no header")
    if row_id in names:
        raise ValueError(f"the table has a column {row_id}")
    out = None
    for head, files in groups.items():
        by_blocks = multi_line and head.encoding.lower() in _BYTEWISE
        made = (_by_records if by_blocks else _by_lines)(spark, files, head, multi_line)
        cells = [(F.coalesce(F.col(f"c{head.names.index(n)}"), F.lit("")) if n in head.names else F.lit("")).alias(f"n{i}") for i, n in enumerate(names)]
        made = made.select("_file", "_block", "_nth", *cells)
        out = made if out is None else out.unionByName(made)
    # Rows by records are numbered within their files, which are then like one block; lines have places in their blocks.
    df = (_numbered(out) if row_id is not None else out.withColumn("_row", F.lit(None).cast("long"))).select("_row", *[f"n{i}" for i in range(len(names))])
    blank = F.lit(True)
    for i in range(len(names)):
        blank = blank & is_empty(F.col(f"n{i}"))
    df = df.filter(~blank)
    return df.toDF(row_id, *names) if row_id is not None else df.drop("_row").toDF(*names)


def _cells(head: Head) -> str:
    return ", ".join(f"c{i} string" for i in range(len(head.names)))


def _by_lines(spark: SparkSession, files: list[str], head: Head, multi_line: bool) -> DataFrame:
    """c0, c1, .. of each line, as Spark reads delimited text, with its file, block and place there."""
    latin = head.encoding == FALLBACK  # Spark reads Latin-1, which windows-1252 widens by some characters in place of control codes
    options = {"header": True, "sep": head.sep, "encoding": "iso-8859-1" if latin else head.encoding, "escape": '"', "multiLine": multi_line, "mode": "PERMISSIVE", "enforceSchema": True}
    df = spark.read.schema(_cells(head)).options(**options).csv(files)
    cells = [(F.translate(c, *_widened()) if latin else F.col(c)).alias(c) for c in df.columns]
    return _placed(df).select("_file", "_block", "_nth", *cells)


def _by_records(spark: SparkSession, files: list[str], head: Head, multi_line: bool) -> DataFrame:
    """The same, of records that may hold line ends: _nth is the record's number in its file."""
    lexer, read = records.Delimited(head.sep), records.lines(spark, files, head.end)
    states = records.placed(records.functions_of(read, lexer)).persist()  # a row per block
    found = records.records(read, lexer, states).filter("number > 0")  # the header is the first
    latin = head.encoding == FALLBACK
    text = F.translate(F.decode("text", F.lit("iso-8859-1")), *_widened()) if latin else F.make_valid_utf8(F.col("text").cast("string"))
    if head.encoding.lower() == "iso-8859-1":
        text = F.decode("text", F.lit("iso-8859-1"))
    row = F.from_csv(F.regexp_replace(text, r"\r\z", ""), _cells(head), {"sep": head.sep, "escape": '"', "multiLine": "true", "mode": "PERMISSIVE"})
    return found.select(F.col("file").alias("_file"), F.lit(0).cast("long").alias("_block"), (F.col("number") - 1).alias("_nth"), row.alias("r")).select("_file", "_block", "_nth", "r.*")


def _widened() -> tuple[str, str]:
    """Latin-1's control codes from 0x80 on, and what windows-1252 has in their place."""
    codes = [b for b in range(0x80, 0xA0) if bytes([b]).decode(FALLBACK, "ignore")]
    return "".join(map(chr, codes)), bytes(codes).decode(FALLBACK)


def _placed(df: DataFrame) -> DataFrame:
    """A table just read from files, with the file, block and place of each row."""
    return df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_nth"))


def _numbered(placed: DataFrame) -> DataFrame:
    """_row, gapless from 0: files by name, blocks as they stand in them, rows by place. A first pass counts the rows of each
    block, a second one shifts places to numbers; no row is shuffled unless the counts (a row per block) are too many to
    broadcast. Both passes are one plan over one listing of files, so they place rows alike."""
    blocks = placed.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min("_nth").alias("_least"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    starts = blocks.select("_file", "_block", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_least")).alias("_shift"))
    return placed.join(starts, ["_file", "_block"]).withColumn("_row", F.col("_nth") + F.col("_shift"))


def with_row_index(df: DataFrame, name: str = "row_id") -> DataFrame:
    """A table just read from files, with row numbers first: gapless from 0, files by name, rows as they stand in them.
    ValueError if the table has a column of that name."""
    if name in df.columns:
        raise ValueError(f"the table has a column {name}")
    names = df.columns
    numbered = _numbered(_placed(df).toDF(*[f"c{i}" for i in range(len(names))], "_file", "_block", "_nth"))
    return numbered.select("_row", *[f"c{i}" for i in range(len(names))]).toDF(name, *names)


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", row_id: str | None = None) -> DataFrame:
    """A table that exists; row_id names a column of row numbers to add."""
    df = spark.read.format(fmt).load(path)
    return df if row_id is None else with_row_index(df, row_id)


def source_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files of a path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sum(system.getContentSummary(status.getPath()).getLength() for status in system.globStatus(p) or ())


def validate_source(df: DataFrame, need_rows: bool = True) -> DataFrame:
    """df itself; SourceError if it has no columns or, where rows are needed, no row."""
    if not df.columns:
        raise SourceError("no-columns", "the table has no columns")
    if need_rows and df.isEmpty():
        raise SourceError("empty-file", "the table has no rows")
    return df


# ---- SQL dumps

_QUOTED = r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\"|`[^`]*`"
_NAME = r"(`[^`]+`|\"[^\"]+\"|\[[^\]]+\]|[\w.$]+)"
_CREATE = re.compile(rf"\bcreate\s+table\s+(?:if\s+not\s+exists\s+)?{_NAME}\s*\(", re.IGNORECASE)
_INSERT = re.compile(rf"\binsert\s+(?:(?:ignore|delayed|low_priority|high_priority)\s+)*into\s+{_NAME}\s*(?:\(((?:{_QUOTED}|[^)'\"`])*)\)\s*)?values\b", re.IGNORECASE | re.DOTALL)
_COMMENT = re.compile(rf"({_QUOTED})|--[^\n]*|#[^\n]*|/\*.*?\*/", re.DOTALL)
_CUT = re.compile(rf"{_QUOTED}|;", re.DOTALL)
_MARK = re.compile(rf"{_QUOTED}|[(),]|[^(),'\"`]+", re.DOTALL)
_OPEN = re.compile(r"[\s,]*\(")
_CONSTRAINT = re.compile(r"^(primary|foreign|unique|key|index|constraint|check|fulltext|spatial)\b", re.IGNORECASE)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}


def _bare(name: str) -> str:
    return name.strip().strip('`"[]')


def statements(text: str) -> list[str]:
    """The statements of a stretch of SQL, without comments, parted by ';' outside of quotes."""
    text, out, start = _COMMENT.sub(lambda m: m[1] or " ", text), [], 0
    for m in _CUT.finditer(text):
        if m[0] == ";":
            out.append(text[start : m.start()])
            start = m.end()
    return [s.strip() for s in (*out, text[start:]) if s.strip()]


def _items(text: str, at: int) -> tuple[list[str], int]:
    """The items of the bracketed list whose first item starts at ``at``, and the place after its end; commas in quotes
    and in inner brackets part nothing."""
    items, depth, start = [], 1, at
    while m := _MARK.match(text, at):
        at, mark = m.end(), m[0]
        depth += (mark == "(") - (mark == ")")
        if (mark, depth) in ((",", 1), (")", 0)):
            items.append(text[start : m.start()])
            start = at
        if not depth:
            return items, at
    raise SourceError("unreadable", f"a list without an end near: {text[start : start + 40]}")


def create_table(statement: str) -> tuple[str, list[tuple[str, str]]] | None:
    """Name and (column, declared type) pairs of a CREATE TABLE statement."""
    m = _CREATE.search(statement)
    if not m:
        return None
    parts = [p.strip() for p in _items(statement, m.end())[0]]
    columns = [re.match(rf"{_NAME}(.*)", p, re.DOTALL) for p in parts if p and not _CONSTRAINT.match(p)]
    return _bare(m[1]), [(_bare(c[1]), c[2].strip()) for c in columns if c]


def literal(token: str) -> str | None:
    """The text of a SQL literal: null, a string with its escapes undone, or, of anything else, the token itself."""
    token = token.strip()
    if token.upper() in ("NULL", ""):
        return None
    q = token[0]
    if q not in "'\"" or not re.fullmatch(_QUOTED, token, re.DOTALL):
        return token
    return re.sub(rf"{q}{q}|\\(.)", lambda m: q if m[0] == q + q else _ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.DOTALL)


def insert_rows(statement: str, table: str, columns: list[str]) -> Iterator[dict[str, str | None]]:
    """The rows of an INSERT for the table, by column; tuples that are short are null at the end. What follows the last
    tuple is no row; a call such as NOW() is kept as its text."""
    m = _INSERT.search(statement)
    if not m or _bare(m[1]).lower() != table.lower():
        return
    names, at = [_bare(c[0]) for c in re.finditer(_NAME, m[2])] if m[2] else columns, m.end()
    while opened := _OPEN.match(statement, at):
        row, at = _items(statement, opened.end())
        yield dict(zip(names, map(literal, row), strict=False))


#: More tuples than a statement of 2 GB can hold.
_TUPLES = 1 << 30


def read_sql_dump(spark: SparkSession, path: str, row_limit: int | None = None, row_id: str | None = None) -> DataFrame:
    """All-text table of a dump's first CREATE TABLE, its rows from INSERTs; row_id names a column to add, of numbers
    that ascend in the dump's order, with gaps.

    Files are cut into statements by blocks, in tasks, whatever strings, quoted names and comments hold, and statements are
    parsed apart."""
    import pandas as pd

    files = [f for f, size in _files(spark, path) if size]
    if not files:
        raise SourceError("empty-file", f"{path} is empty")
    lexer, out = records.Statements(), None
    found: dict[str, list[str]] = {}
    for file in files:
        found.setdefault(detect_encoding(_head(spark, file)), []).append(file)
    starts = None
    for encoding, some in found.items():
        read = records.lines(spark, some)
        states = records.placed(records.functions_of(read, lexer)).persist()  # a row per block
        latin = encoding == FALLBACK
        text = F.translate(F.decode("text", F.lit("iso-8859-1")), *_widened()) if latin else F.make_valid_utf8(F.col("text").cast("string"))
        part = records.records(read, lexer, states).select("file", "number", text.alias("s"))
        out, starts = (part, states) if out is None else (out.unionByName(part), starts.unionByName(states))
    pieces = out.join(records.file_starts(starts), "file").select((F.col("start") + F.col("number")).alias("o"), "s")

    def creations(frames):
        for frame in frames:
            made = [(o, s) for o, text in zip(frame["o"], frame["s"], strict=True) for s in statements(text) if create_table(s)]
            yield pd.DataFrame(made, columns=["o", "s"])

    first = pieces.filter(F.lower("s").rlike(r"create\s+table")).mapInPandas(creations, "o long, s string").orderBy("o").limit(1).collect()
    made = create_table(first[0]["s"]) if first else None
    if not made or not made[1]:
        raise SourceError("no-columns", f"{path} has no CREATE TABLE")
    table, columns = made[0], unique_headers([c for c, _ in made[1]])
    if row_id in columns:
        raise ValueError(f"the table has a column {row_id}")

    def parse(frames):
        for frame in frames:
            rows = []
            for o, text in zip(frame["o"], frame["s"], strict=True):
                found = (r for s in statements(text) for r in insert_rows(s, table, columns))
                rows += [[o * _TUPLES + k, *map(r.get, columns)] for k, r in enumerate(found)]
            yield pd.DataFrame(rows, columns=["o", *(f"c{i}" for i in range(len(columns)))], dtype=object)

    schema = ", ".join(["o long", *(f"c{i} string" for i in range(len(columns)))])
    rows = pieces.filter(F.lower("s").rlike(r"\binsert\b")).mapInPandas(parse, schema)
    rows = rows.toDF(row_id, *columns) if row_id is not None else rows.drop("o").toDF(*columns)
    return rows if row_limit is None else rows.limit(row_limit)
