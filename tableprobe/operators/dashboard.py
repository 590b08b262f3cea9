"""Aggregates of a dashboard: segments, KPIs, breakdowns, notices, charts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableprobe.functions.values import coerce_to_number, col, severity_rank, trimmed
from tableprobe.operators import calendar, numeric, quality
from tableprobe.operators.quality import text_columns
from tableprobe.operators.shape import cells, over_kept

LEAST_VALUES, MOST_VALUES, GROUPS, NOTICES, CHARTS = 2, 15, 6, 4, 2
MISSING, OTHER = "(missing)", "Other"
# Words in column names, in the order in which they are tried.
BUSINESS_WORDS = "status|channel|category|segment|region|country|type"
MEASURE_WORDS = ("total", "amount", "revenue", "value", "price", "qty|quantity")
DATE_WORDS = ("order", "created", "placed", "date")
NEVER_SUMMED = (
    r"\bage\b", r"\byear\b", "rating", r"\bscore\b", r"\brank\b", r"percent|\bpct\b|%", r"\brate\b", r"\bratio\b", r"\bindex\b", r"\bid\b",
    "zip|postal", r"latitude|longitude|\blat\b|\blon\b|\blng\b",
)


def spoken(name: str) -> str:
    """A column name with runs of underscores and hyphens as blanks."""
    return re.sub(r"[_-]+", " ", name)


def _first(names: list[str], words: tuple[str, ...], say=spoken) -> str | None:
    return next((n for w in words for n in names if re.search(w, say(n), re.IGNORECASE)), None)


def choose_measure_column(names: list[str]) -> str | None:
    """By name, else the first numeric column that it makes sense to sum."""
    summable = [n for n in names if not any(re.search(w, spoken(n), re.IGNORECASE) for w in NEVER_SUMMED)]
    return _first(names, MEASURE_WORDS) or next(iter(summable), None)


def choose_date_column(names: list[str]) -> str | None:
    return _first(names, DATE_WORDS, str) or next(iter(names), None)


def filter_by_category(df: DataFrame, column: str, value: str | None) -> DataFrame:
    """Rows whose trimmed cell is the value; all rows for null."""
    return df if value is None else df.filter(trimmed(col(column).cast("string")) == value)


def _category(df: DataFrame, column: str) -> Column:
    text = trimmed(col(column).cast("string"))
    return F.when(text != "", text)


def distinct_categories(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, idx, n_values, vals (sorted): text columns with 2 to 15 trimmed values. A sketch rules out
    columns with far more before any value is gathered."""
    texts = text_columns(df, columns)
    spark, schema = df.sparkSession, "column string, idx int, n_values int, vals array<string>"
    if not texts:
        return spark.createDataFrame([], schema)
    rough = df.agg(*[F.approx_count_distinct(_category(df, c), 0.02).alias(f"n{i}") for i, c in enumerate(texts)]).first()
    few = [c for i, c in enumerate(texts) if rough[i] <= 2 * MOST_VALUES]
    if not few:
        return spark.createDataFrame([], schema)
    long = cells(df.withColumn("_r", F.lit(0)), few, "_r", lambda c: _category(df, c)).filter("value is not null").select("column", "value").distinct()
    place = F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(c), F.lit(i))])
    found = long.groupBy("column").agg(F.array_sort(F.collect_set("value")).alias("vals"))  # 30 or so values at most
    return found.select("column", place[F.col("column")].alias("idx"), F.size("vals").alias("n_values"), "vals").filter(F.col("n_values").between(LEAST_VALUES, MOST_VALUES))


def rank_filter_columns(candidates: DataFrame, inconsistent: DataFrame) -> DataFrame:
    """Candidates, the least messy (fewest clusters) first, then those with more values, then in column order."""
    mess = inconsistent.select("column", F.col("clusters").alias("messiness"))
    ranked = candidates.join(mess, "column", "left").withColumn("messiness", F.coalesce("messiness", F.lit(0)))
    return ranked.withColumn("rank", F.row_number().over(Window.orderBy("messiness", F.desc("n_values"), "idx")))  # a row per column


def choose_secondary_column(ranked: DataFrame, exclude: str) -> str | None:
    """The best ranked other column, one with a business word in its name first."""
    other = ranked.filter(F.col("column") != exclude).withColumn("hinted", F.lower("column").rlike(BUSINESS_WORDS))
    row = other.orderBy(F.desc("hinted"), "rank").head(1)
    return row[0]["column"] if row else None


def kpi_rows_in_view(view: DataFrame, total_rows: int) -> DataFrame:
    return view.agg(F.count("*").alias("n_rows")).withColumn("percentage", F.lit(0.0) if not total_rows else F.col("n_rows") * 100.0 / total_rows)


def kpi_measure(view: DataFrame, measure: str) -> DataFrame:
    x = coerce_to_number(col(measure), view.schema[measure].dataType)
    return view.agg(F.sum(x).alias("total"), F.avg(x).alias("mean"), F.count(x).alias("n"))


def kpi_top_category(view: DataFrame, column: str, row_id: str = "row_id") -> DataFrame:
    """The most frequent trimmed value (ties: seen first), n, and its share of the view's rows."""
    groups = view.groupBy(_category(view, column).alias("value")).agg(F.count("*").alias("n"), F.min(col(row_id)).alias("seen"))
    rows = groups.agg(F.sum("n").alias("n_rows"))
    top = groups.filter("value is not null").orderBy(F.desc("n"), "seen").limit(1)
    return top.crossJoin(rows).select("value", "n", (F.col("n") * 100.0 / F.col("n_rows")).alias("percentage"))  # one row by one row


def segment_kpis(df: DataFrame, segment: str, measure: str, total_rows: int | None = None) -> DataFrame:
    """segment (null: all rows), n_rows, percentage, total, mean: one pass for every value of the segment."""
    x = coerce_to_number(col(measure), df.schema[measure].dataType)
    base = df.select(_category(df, segment).alias("segment"), x.alias("x"))
    found = base.rollup("segment").agg(F.grouping("segment").alias("g"), F.count("*").alias("n_rows"), F.sum("x").alias("total"), F.avg("x").alias("mean"))
    found = found.filter("g = 1 or segment is not null")
    whole = F.lit(total_rows) if total_rows is not None else F.max(F.when(F.col("g") == 1, F.col("n_rows"))).over(Window.partitionBy())
    return found.select("segment", (F.col("g") == 1).alias("is_total"), "n_rows", (F.col("n_rows") * 100.0 / whole).alias("percentage"), "total", "mean")  # a row per segment


#: Parts into which groups are dealt before their largest are chosen.
_PARTS = 64


def _folded(groups: DataFrame) -> DataFrame:
    """name, place, value: more than six groups become the five largest and the rest. Groups are made once, and dealt into
    parts; each part gives its six largest and the sum of its others, and those of all parts make the answer."""
    part = F.pmod(F.xxhash64("name"), F.lit(_PARTS)).alias("p")
    ranked = groups.select(part, "name", "value", "seen").withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy(F.desc("value"), "seen")))
    top = F.when(F.col("r") <= GROUPS, F.struct("value", "seen", "name"))
    parts = ranked.groupBy("p").agg(F.collect_list(top).alias("top"), F.sum(F.when(F.col("r") > GROUPS, F.col("value"))).alias("rest"), F.count("*").alias("k"))  # six a part
    later = lambda x, y: F.when(x["value"] > y["value"], -1).when(x["value"] < y["value"], 1).when(x["seen"] < y["seen"], -1).when(x["seen"] > y["seen"], 1).otherwise(0)
    whole = parts.agg(F.array_sort(F.flatten(F.collect_list("top")), later).alias("top"), F.sum("rest").alias("rest"), F.sum("k").alias("k"))  # _PARTS rows
    kept = F.when(F.col("k") > GROUPS, GROUPS - 1).otherwise(GROUPS)
    value = dict(groups.dtypes)["value"]
    total = F.aggregate(F.slice("top", kept + 1, F.size("top") + 1), F.coalesce(F.col("rest"), F.lit(0)).cast(value), lambda a, x: (a + x["value"]).cast(value))
    named = lambda name, place, v: F.struct(name.alias("name"), place.alias("place"), v.cast(value).alias("value"))
    first = F.transform(F.slice("top", F.lit(1), kept), lambda x, i: named(x["name"], i + 1, x["value"]))
    other = F.when(F.col("k") > GROUPS, F.array(named(F.lit(OTHER), F.lit(GROUPS), total))).otherwise(F.array().cast(f"array<struct<name:string,place:int,value:{value}>>"))
    return whole.filter("top is not null").select(F.explode(F.concat(first, other)).alias("e")).select("e.*")


def category_breakdown(df: DataFrame, column: str, row_id: str = "row_id") -> DataFrame:
    """name, place, value: rows per trimmed value."""
    name = F.coalesce(_category(df, column), F.lit(MISSING))
    return _folded(df.groupBy(name.alias("name")).agg(F.count("*").alias("value"), F.min(col(row_id)).alias("seen")))


def category_measure_breakdown(df: DataFrame, column: str, measure: str, row_id: str = "row_id") -> DataFrame:
    """name, place, value: sum of the measure; rows without a number are left out."""
    x = coerce_to_number(col(measure), df.schema[measure].dataType)
    name = F.coalesce(_category(df, column), F.lit(MISSING))
    rows = df.select(name.alias("name"), x.alias("x"), col(row_id).alias("row_id")).filter("x is not null")
    return _folded(rows.groupBy("name").agg(F.sum("x").alias("value"), F.min("row_id").alias("seen")))


def _noticed(report: DataFrame, outliers: DataFrame, sizes: DataFrame) -> DataFrame:
    """g, rank, id, severity, count: at most four notices of each view g, of findings and outliers by g. sizes: g, n_rows."""
    top = lambda df, kind, k, order: df.withColumn("nth", F.row_number().over(Window.partitionBy("g").orderBy(*order))).filter(F.col("nth") <= k).withColumn("kind", F.lit(kind))
    of = lambda check: report.filter((F.col("check_name") == check) & (F.col("count") > 0))
    named = lambda df, word, c="count": df.select("g", F.concat(F.lit(word), "column").alias("id"), "severity", F.col(c).cast("long").alias("count"), "kind", "nth")
    found = named(top(of("missing-values"), 0, 2, [F.desc("count"), "idx"]), "missing-")
    for p in (
        named(top(of("duplicate-rows"), 1, 1, ["idx"]), "duplicates"),
        named(top(outliers.filter("n_outliers > 0").withColumn("severity", F.lit("warning")), 2, 2, [F.desc("n_outliers"), "idx"]), "outliers-", "n_outliers"),
        named(top(of("inconsistent-categoricals"), 3, 1, ["idx"]), "inconsistent-"),
    ):
        found = found.unionByName(p)
    none = F.col("n_rows") == 0
    # Stands last, and alone only where nothing else does; a view without rows has only its own notice.
    plain = sizes.select("g", F.when(none, "no-rows").otherwise("clean").alias("id"), F.when(none, "warning").otherwise("info").alias("severity"), F.lit(0).cast("long").alias("count"), F.when(none, -1).otherwise(9).alias("kind"), F.lit(1).alias("nth"))
    order = Window.partitionBy("g").orderBy((F.col("kind") >= 0).cast("int"), severity_rank(F.col("severity")), "kind", "nth")
    ranked = found.unionByName(plain).withColumn("rank", F.row_number().over(order)).withColumn("first", F.first("id").over(order))
    alone = (F.col("id") != "clean") | (F.col("rank") == 1)
    return ranked.filter((F.col("rank") <= NOTICES) & alone & ((F.col("first") != "no-rows") | (F.col("rank") == 1))).select("g", "rank", "id", "severity", "count")


def dashboard_notices(report: DataFrame, outliers: DataFrame, n_rows: int) -> DataFrame:
    """rank, id, severity, count: at most four notices of a view, the gravest first."""
    g = lambda df: df.withColumn("g", F.lit(None).cast("string"))
    sizes = report.sparkSession.createDataFrame([(None, n_rows)], "g string, n_rows long")
    return _noticed(g(report), g(outliers), sizes).drop("g")


def segment_notices(df: DataFrame, columns: list[str], numbers: list[str], segment: str, row_id: str = "row_id") -> DataFrame:
    """segment (null: all rows), rank, id, severity, count: the notices of the whole table and of the view of every value of
    the segment's column, each as if the view were analysed alone. A segment's column has MOST_VALUES values at most."""
    return over_kept(df, lambda d: _segment_notices(d, columns, numbers, segment, row_id))


def _segment_notices(df: DataFrame, columns: list[str], numbers: list[str], segment: str, row_id: str) -> DataFrame:
    g = _category(df, segment)
    values = sorted(r[0] for r in df.select(g.alias("g")).filter("g is not null").distinct().limit(MOST_VALUES + 1).collect())
    if len(values) > MOST_VALUES:
        raise ValueError(f"{segment} has more than {MOST_VALUES} values")
    sizes = df.select(g.alias("g")).rollup("g").agg(F.grouping("g").alias("whole"), F.count("*").alias("n_rows")).filter("whole = 1 or g is not null").select("g", "n_rows")
    found = _noticed(quality.quality_report_by(df, columns, g, row_id), numeric.outlier_counts_by(df, numbers, g, values), sizes)
    return found.withColumnRenamed("g", "segment")


def choose_charts(df: DataFrame, date_column: str | None, breakdowns: list[str], measure: str | None, row_id: str = "row_id", k: int = CHARTS) -> DataFrame:
    """chart (1..k), id, place, label, value: the first k charts that have data, of trend, breakdowns, distribution. A few
    rows, looked at here, tell which have any; the others are not computed."""
    there = lambda x: not df.select(x.alias("x")).filter("x is not null").isEmpty()  # noqa: E731  one row tells, as a rule from the first file
    measured = bool(measure) and there(coerce_to_number(col(measure), df.schema[measure].dataType))
    made: list[tuple[str, DataFrame]] = []
    if date_column and there(calendar._parsed(df, date_column)):
        trend = calendar.trend_monthly(df, date_column)
        made.append(("trend", trend.select(F.row_number().over(Window.orderBy("month")).alias("place"), F.col("month").alias("label"), F.col("n").cast("double").alias("value"))))
    for c in breakdowns if measured or not measure and not df.isEmpty() else []:
        if len(made) < k:
            part = category_measure_breakdown(df, c, measure, row_id) if measure else category_breakdown(df, c, row_id)
            made.append((f"breakdown-{c}", part.select("place", F.col("name").alias("label"), F.col("value").cast("double").alias("value"))))
    if measured and len(made) < k:
        bins = numeric.numeric_distribution(df, measure)
        made.append((f"distribution-{measure}", bins.select((F.col("bin") + 1).alias("place"), F.col("bin").cast("string").alias("label"), F.col("n").cast("double").alias("value"))))
    out = None
    for order, (name, part) in enumerate(made):
        part = part.select(F.lit(order).alias("o"), F.lit(name).alias("id"), "place", "label", "value")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return df.sparkSession.createDataFrame([], "chart int, id string, place int, label string, value double")
    return out.filter(F.col("o") < k).select((F.col("o") + 1).alias("chart"), "id", "place", "label", "value")


def ranked_by_count(findings: DataFrame, count: str = "count") -> DataFrame:
    """Findings that found something, most first."""
    return findings.filter(F.col(count) > 0).orderBy(F.desc(count), "idx")
