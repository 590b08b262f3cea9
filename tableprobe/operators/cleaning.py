"""A declarative cleaning plan, applied as one plan, with an audit of what it changed."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableprobe.functions.values import coerce_value, col, is_empty

MAX_COLUMNS = 500
ACTIONS = ("drop-row", "fill-default", "leave-null")
TARGETS = ("string", "integer", "float", "number", "date", "boolean")
CHANGES = ("value-mapping", "type-coercion", "missing-value", "skipped-invalid-column")


class PlanError(ValueError):
    pass


@dataclass(frozen=True)
class ColumnPlan:
    column: str
    mappings: tuple[tuple[str, str, str], ...] = ()  # from, to, reason
    missing: tuple[str, str | None, str] | None = None  # action, default, reason
    coercion: tuple[str, str] | None = None  # target, reason


@dataclass(frozen=True)
class Plan:
    columns: tuple[ColumnPlan, ...] = field(default_factory=tuple)
    summary: str | None = None


def _text(entry: dict, name: str) -> str:
    value = entry.get(name)
    if not isinstance(value, str) or not value:
        raise PlanError(f"{name} must be text that is not empty")
    return value


def _as_text(value) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (str, int, float)):
        return str(value)
    raise PlanError("defaultValue must be text, a number or a boolean")


def load_plan(source: str | dict) -> Plan:
    """A plan from its JSON, or PlanError with what is wrong."""
    data = json.loads(source) if isinstance(source, str) else source
    entries = data.get("columns") if isinstance(data, dict) else None
    if not isinstance(entries, list):
        raise PlanError("columns must be a list")
    if len(entries) > MAX_COLUMNS:
        raise PlanError(f"a plan has at most {MAX_COLUMNS} columns")
    if "summary" in data:
        _text(data, "summary")
    plans = []
    for e in entries:
        mappings = tuple((_text(m, "from"), _text(m, "to"), _text(m, "reason")) for m in e.get("valueMappings") or ())
        missing, coercion = e.get("missingValuePolicy"), e.get("typeCoercion")
        if missing is not None:
            if missing.get("action") not in ACTIONS:
                raise PlanError(f"no such action: {missing.get('action')}")
            default = _as_text(missing.get("defaultValue")) if missing["action"] == "fill-default" else None
            missing = (missing["action"], default, _text(missing, "reason"))
        if coercion is not None:
            if coercion.get("targetType") not in TARGETS:
                raise PlanError(f"no such type: {coercion.get('targetType')}")
            coercion = (coercion["targetType"], _text(coercion, "reason"))
        if not mappings and missing is None and coercion is None:
            raise PlanError("a column plan needs at least one action")
        plans.append(ColumnPlan(_text(e, "columnName"), mappings, missing, coercion))
    return Plan(tuple(plans), data.get("summary"))


def composed(mappings: list[tuple[str, str]]) -> dict[str, tuple[str, tuple[int, ...]]]:
    """from -> final to and the places of the mappings on its way, when each mapping sees the one before's result."""
    at: dict[str, list[str]] = {}  # where a value stands now: the values that started there or came there
    way: dict[str, list[int]] = {}
    for k, (a, b) in enumerate(mappings):
        come = at.pop(a, [])
        if a not in way:
            way[a] = []
            come.append(a)
        for start in come:
            way[start].append(k)
        at.setdefault(b, []).extend(come)
    return {start: (b, tuple(way[start])) for b, starts in at.items() for start in starts}


def _dictionary(start: dict[str, tuple[str, int]]) -> Callable[[Column], Column]:
    """struct(t, k) of a cell that is a key, else null: a constant table of small maps, found by the cell's checksum, so that
    a look-up costs the same for few entries and for many."""
    n = max(1, len(start) // 4)
    maps: list[dict[str, dict]] = [{} for _ in range(n)]
    for key, (to, code) in start.items():
        maps[zlib.crc32(key.encode()) % n][key] = {"t": to, "k": code}
    table = F.from_json(F.lit(json.dumps(maps)), "array<map<string,struct<t:string,k:int>>>")
    return lambda c: F.try_element_at(F.get(table, (F.crc32(c.cast("binary")) % n).cast("int")), c)


_TYPES = {"integer": "bigint", "float": "double", "number": "double", "boolean": "boolean", "date": "date"}


def _typed_value(text: Column, target: str) -> Column:
    """Canonical text as the target's type; null where it is none."""
    return F.try_to_date(text, "yyyy-MM-dd") if target == "date" else text.try_cast(_TYPES[target])


class _Marks:
    """Codes of what may happen to a cell, and to which entries of the audit each counts."""

    def __init__(self) -> None:
        self.entries: list[tuple[str, str, str, str]] = []  # column, change, detail, reason
        self.links: list[tuple[int, int, bool]] = []  # code, entry, failed
        self.codes = 0

    def entry(self, column: str, change: str, detail: str, reason: str) -> int:
        self.entries.append((column, change, detail, reason))
        return len(self.entries) - 1

    def code(self, *entries: int, failed: bool = False) -> int:
        self.codes += 1
        self.links += [(self.codes, e, failed) for e in entries]
        return self.codes

    def audit(self, marked: DataFrame) -> DataFrame:
        """The audit of rows with marks under _hits: one group-by, of as many groups as codes."""
        spark = marked.sparkSession
        counts = marked.select(F.explode("_hits").alias("code")).groupBy("code").agg(F.count("*").alias("n"))
        links = spark.createDataFrame(self.links, "code int, seq int, failed boolean")
        sums = links.join(counts, "code").groupBy("seq").agg(F.sum(F.when(~F.col("failed"), F.col("n"))).alias("affected"), F.sum(F.when(F.col("failed"), F.col("n"))).alias("failures"))
        entries = spark.createDataFrame([(k, *e) for k, e in enumerate(self.entries)], "seq int, column string, change_type string, detail string, reason string")
        affected = F.coalesce("affected", F.lit(0).cast("long"))
        done = (affected > 0) & ~F.col("detail").eqNullSafe("leave-null")
        return entries.join(sums, "seq", "left").select(*entries.columns, affected.alias("affected_rows"), F.coalesce("failures", F.lit(0).cast("long")).alias("failed_rows"), done.alias("applied"))


def _staged(df: DataFrame, plan: Plan, typed: bool) -> tuple[DataFrame, list[str], _Marks]:
    """df's columns after the plan as c0, c1, .., with _hits (codes of what happened to the row) and _gone; the names of the
    columns; and the marks."""
    marks, names = _Marks(), df.columns
    place = {c: i for i, c in reversed(list(enumerate(names)))}
    now = df.toDF(*[f"c{i}" for i in range(len(names))]).withColumns({"_hits": F.array().cast("array<int>")})
    seen: dict[int, int] = {}  # plans of a column before this one
    rounds: list[list[ColumnPlan]] = []
    kinds: dict[int, str] = {}
    steps: dict[int, tuple[list[int], list[int], tuple[int, int] | None]] = {}
    for n, p in enumerate(plan.columns):
        if p.column not in place:
            marks.entry(p.column, CHANGES[3], "", "column is not in the table")
            continue
        k = seen[place[p.column]] = seen.get(place[p.column], -1) + 1
        rounds += [[]] * (k >= len(rounds))
        rounds[k] = [*rounds[k], p]
        maps = [marks.entry(p.column, CHANGES[0], f"{a} -> {b}", reason) for a, b, reason in p.mappings]
        coerced = marks.entry(p.column, CHANGES[1], *p.coercion) if p.coercion else None
        steps[n] = maps, [], (marks.code(coerced), marks.code(coerced, failed=True)) if coerced is not None else None
    number = {id(p): n for n, p in enumerate(plan.columns)}
    extra: dict[int, str] = {}
    for group in rounds:
        here = {place[p.column]: p for p in group}
        looked, hits = [], []
        for i, p in here.items():
            maps = steps[number[id(p)]][0]
            ways = composed([m[:2] for m in p.mappings])
            start = {a: (b, marks.code(*(maps[k] for k in way))) for a, (b, way) in ways.items()}
            c = F.col(f"c{i}").cast("string")
            looked.append((_dictionary(start)(c) if start else F.lit(None).cast("struct<t:string,k:int>")).alias(f"m{i}"))
        now = now.select("*", *looked)
        made = []
        for i, p in here.items():
            value = F.coalesce(F.col(f"m{i}.t"), F.col(f"c{i}").cast("string"))
            hits.append(F.col(f"m{i}.k"))
            if p.coercion:
                text, ok = coerce_value(value, p.coercion[0])
                made.append(F.struct(text.alias("v"), ok.alias("ok"), (~is_empty(value)).alias("full"), value.alias("cell")).alias(f"k{i}"))
            else:
                made.append(F.struct(value.alias("v")).alias(f"k{i}"))
        now = now.select("*", *made)
        for i, p in here.items():
            if p.coercion:
                good, bad = steps[number[id(p)]][2]
                fits = F.col(f"k{i}.ok")
                if typed and p.coercion[0] in _TYPES:
                    fits = fits & _typed_value(F.col(f"k{i}.v"), p.coercion[0]).isNotNull()
                hits.append(F.when(F.col(f"k{i}.full"), F.when(F.coalesce(fits, F.lit(False)), good).otherwise(bad)))
        marked = F.concat("_hits", F.array_compact(F.array(*hits)))
        cells = []
        for i in range(len(names)):
            p = here.get(i)
            if p and typed and p.coercion and p.coercion[0] in _TYPES:
                kinds[i] = p.coercion[0]
                value = _typed_value(F.when(F.col(f"k{i}.ok"), F.col(f"k{i}.v")), p.coercion[0])
                extra[i] = f"u{i}"
                cells += [value.alias(f"c{i}"), F.when(F.col(f"k{i}.full") & value.isNull(), F.col(f"k{i}.cell")).alias(f"u{i}")]
            else:
                cells.append((F.col(f"k{i}.v") if p else F.col(f"c{i}")).alias(f"c{i}"))
                cells += [F.col(f"u{i}")] if i in extra else []
        now = now.select(*cells, marked.alias("_hits"))
    last, gone, hits = {}, F.lit(False), []
    for p in plan.columns:
        if p.missing and p.column in place:
            i, (action, default, reason) = place[p.column], p.missing
            kind = kinds.get(i)
            # A typed cell that could not be coerced is not empty.
            empty = F.col(f"c{i}").isNull() & F.col(f"u{i}").isNull() if kind else is_empty(F.col(f"c{i}").cast("string"))
            hits.append(F.when(empty, marks.code(marks.entry(p.column, CHANGES[2], action, reason))))
            if action == "drop-row":
                gone = gone | empty
            elif action == "fill-default":
                fill = F.lit(default) if not kind else _typed_value(F.lit(default), kind)
                last[i] = F.when(empty, fill).otherwise(F.col(f"c{i}"))
    cells = [last.get(i, F.col(f"c{i}")).alias(f"c{i}") for i in range(len(names))] + [F.col(u) for u in extra.values()]
    staged = now.select(*cells, F.concat("_hits", F.array_compact(F.array(*hits)) if hits else F.array().cast("array<int>")).alias("_hits"), gone.alias("_gone"))
    return staged, [*names, *(f"{names[i]}_uncoerced" for i in extra)], marks


def apply_cleaning_plan(df: DataFrame, plan: Plan, typed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(cleaned, audit). Mappings in their order, then coercion, then, over all columns, missing values.

    Touched columns are text afterwards; a cell that cannot be coerced stays as it is and counts as failed. With typed,
    a coerced column has the target's type, null where a cell could not be coerced, and that cell stands in a column
    named after it with ``_uncoerced``. Dropped rows are those that any drop-row column lacks. Both tables are plans over
    df: nothing runs here, and each reads the source once, however many columns and mappings there are."""
    staged, names, marks = _staged(df, plan, typed)
    return staged.filter(~F.col("_gone")).drop("_hits", "_gone").toDF(*names), marks.audit(staged)


def write_cleaned(df: DataFrame, plan: Plan, path: str, typed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(cleaned, audit) as apply_cleaning_plan has them, the source read once: all rows are written as Parquet below path,
    with the marks of what happened to them; the audit reads the marks alone, and what was dropped stays apart."""
    staged, names, marks = _staged(df, plan, typed)
    staged.write.partitionBy("_gone").parquet(path)
    back = df.sparkSession.read.schema(staged.schema).parquet(path)
    return back.filter(~F.col("_gone")).drop("_hits", "_gone").toDF(*names), marks.audit(back)


def cleaning_summary(audit: DataFrame) -> DataFrame:
    """change_type, entries and applied_rows, in the fixed order of change types."""
    order = F.coalesce(*[F.when(F.col("change_type") == c, i) for i, c in enumerate(CHANGES)])
    found = audit.groupBy("change_type").agg(F.count("*").alias("entries"), F.sum(F.when(F.col("applied"), F.col("affected_rows")).otherwise(0)).alias("applied_rows"))
    return found.withColumn("place", order).orderBy("place")


def changed_columns(audit: DataFrame) -> DataFrame:
    return audit.filter(F.col("applied") & F.col("change_type").isin("value-mapping", "type-coercion")).select("column").distinct()


def raw_vs_cleaned(raw: DataFrame, cleaned: DataFrame, audit: DataFrame) -> DataFrame:
    """One row: raw_rows, cleaned_rows, n_changed_columns."""
    a = raw.agg(F.count("*").alias("raw_rows"))
    b = cleaned.agg(F.count("*").alias("cleaned_rows"))
    return a.crossJoin(b).crossJoin(changed_columns(audit).agg(F.count("*").alias("n_changed_columns")))  # one row each


def preview(df: DataFrame, row_id: str = "row_id", k: int = 50) -> DataFrame:
    """The first k rows in order."""
    return df.orderBy(col(row_id)).limit(k)
