"""Data quality: missing values, duplicate rows, mixed types, categories spelled in several ways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableprobe.functions.values import INCONSISTENT_ERROR, col, empty_of, normalize_category, percentage_of, severity_of, severity_rank, trimmed_bucket, typed_bucket
from tableprobe.operators.shape import filled_cells, first_rows, long_cells, over_kept, per_column

MAX_CATEGORIES, MAX_DISTANCE, SAMPLES = 49, 2, 5
BUCKETS = ("number", "boolean", "date", "string")
FINDING = ("check_name", "column", "idx", "count", "percentage", "severity")


def missing_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """A finding for every column."""
    found = per_column(df, columns, lambda c: {"count": F.count_if(empty_of(df, c)), "total": F.count("*")})
    found = found.withColumn("percentage", percentage_of(F.col("count"), F.col("total")))
    return found.withColumns({"check_name": F.lit("missing-values"), "severity": severity_of("missing-values", F.col("count"), F.col("percentage"))}).select(*FINDING)


def _suspects(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose hash over the columns repeats: all duplicates, and few others. Hashes alone are shuffled; those that repeat
    set bits of 2^20 words at most, which are broadcast, so that no other row is shuffled, however many there are."""
    hashed = df.withColumn("_h", F.xxhash64(*[F.struct(col(c).isNull(), col(c)) for c in columns]))
    word, bit = F.shiftrightunsigned("_h", 44), F.col("_h").bitwiseAND(63).cast("int")
    repeated = hashed.groupBy("_h").agg(F.count("*").alias("_n")).filter("_n > 1")
    words = repeated.groupBy(word.alias("_w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_h & 63L as int))")).alias("_bits"))
    found = hashed.withColumn("_w", word).join(F.broadcast(words), "_w")  # 2^20 rows
    return found.filter(F.getbit("_bits", bit) == 1).select(*[col(c) for c in df.columns])


def duplicate_groups(df: DataFrame, columns: list[str]) -> DataFrame:
    return _suspects(df, columns).groupBy(*map(col, columns)).agg(F.count("*").alias("_copies")).filter("_copies > 1")


def duplicate_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """One finding: copies beyond the first, and groups; nulls are equal."""
    extra = duplicate_groups(df, columns).agg(F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("count"), F.count("*").alias("groups"))
    found = extra.crossJoin(df.agg(F.count("*").alias("total")))  # one row by one row
    found = found.withColumn("percentage", percentage_of(F.col("count"), F.col("total")))
    return found.withColumns(
        {"check_name": F.lit("duplicate-rows"), "column": F.lit(""), "idx": F.lit(-1), "severity": severity_of("duplicate-rows", F.col("count"), F.col("percentage"))}
    ).select(*FINDING, "groups")


def duplicate_samples(df: DataFrame, columns: list[str], row_id: str = "row_id", k: int = SAMPLES) -> DataFrame:
    """The first k rows that repeat an earlier one."""
    nth = F.row_number().over(Window.partitionBy(*map(col, columns)).orderBy(col(row_id)))
    return _suspects(df, columns).withColumn("_nth", nth).filter("_nth > 1").drop("_nth").orderBy(col(row_id)).limit(k)


def type_buckets(df: DataFrame, columns: list[str], row_id: str = "row_id") -> DataFrame:
    """column, idx, bucket, n, first_row. Cells are counted within tasks: few rows a column are shuffled."""
    found = _bucketed(df, columns, row_id)
    return found.select(F.array(*map(F.lit, columns))[F.col("idx")].alias("column"), "idx", "bucket", "n", "first_row")


def _bucketed(df: DataFrame, columns: list[str], row_id: str, by: Column | None = None) -> DataFrame:
    """idx, bucket, n, first_row (and g). Empty cells are counted too and dropped by an aggregate: a filter of cells would trim
    each a second time, and make the generated code too large to be compiled."""
    filled = F.col("kind").isNotNull() | (F.col("s") != "")
    bucket = F.coalesce("kind", trimmed_bucket(F.col("s"))).alias("bucket")
    keys = ["g"] if by is not None else []
    counted = long_cells(df, columns, row_id, typed_bucket, by).groupBy(*keys, "idx", bucket).agg(F.count_if(filled).alias("n"), F.min(F.when(filled, F.col("row_id"))).alias("first_row"))
    return counted.filter("n > 0")


def mixed_types(df: DataFrame, columns: list[str], row_id: str = "row_id") -> DataFrame:
    """A finding for every column of more than one bucket: cells outside its dominant one (ties: seen first). Only text
    can be of several."""
    if not (texts := text_columns(df, columns)):
        return df.sparkSession.createDataFrame([], "check_name string, column string, idx int, count long, percentage double, severity string, dominant string")
    place = F.array(*[F.lit(columns.index(c)) for c in texts])[F.col("idx")]
    ranked = type_buckets(df, texts, row_id).withColumn("idx", place).withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "first_row")))
    found = ranked.groupBy("column", "idx").agg(
        F.sum("n").alias("total"), F.sum(F.when(F.col("rank") > 1, F.col("n")).otherwise(0)).alias("count"),
        F.max(F.when(F.col("rank") == 1, F.col("bucket"))).alias("dominant"), F.count("*").alias("buckets"),
    ).filter("buckets > 1")
    found = found.withColumn("percentage", percentage_of(F.col("count"), F.col("total")))
    return found.withColumns({"check_name": F.lit("mixed-types"), "severity": severity_of("mixed-types", F.col("count"), F.col("percentage"))}).select(*FINDING, "dominant")


def mixed_type_examples(df: DataFrame, columns: list[str], row_id: str = "row_id", k: int = SAMPLES) -> DataFrame:
    """column, place, bucket, value: the first k cells per bucket, buckets as first seen, k in all."""
    mixed = [r["column"] for r in mixed_types(df, columns, row_id).select("column").collect()]  # a row per column
    names = F.array(*map(F.lit, mixed)).cast("array<string>")
    long = filled_cells(df, mixed, row_id, typed_bucket) if mixed else df.sparkSession.createDataFrame([], f"row_id {df.schema[row_id].dataType.simpleString()}, idx int, kind string, text string, s string")
    long = long.select("row_id", names[F.col("idx")].alias("column"), trimmed_bucket(F.col("s")).alias("bucket"), "text")
    first = first_rows(long, ["column", "bucket"], [F.col("row_id")], k, "nth")
    first = first.withColumn("seen", F.min("row_id").over(Window.partitionBy("column", "bucket")))
    return first_rows(first, ["column"], [F.col("seen"), F.col("row_id")], k, "place").select("column", "place", "bucket", F.col("text").alias("value"))


def text_columns(df: DataFrame, columns: list[str]) -> list[str]:
    return [c for c in columns if isinstance(df.schema[c].dataType, T.StringType)]


def category_values(df: DataFrame, columns: list[str], most: int = MAX_CATEGORIES) -> DataFrame:
    """column, idx, value, n: distinct raw values of text columns that have 1 to most of them."""
    names = F.array(*map(F.lit, columns))
    return _grouped_values(df, columns, most).select(names[F.col("idx")].alias("column"), "idx", "value", "n")


def _grouped_values(df: DataFrame, columns: list[str], most: int, by: Column | None = None) -> DataFrame:
    """g, idx, value, n: as category_values, in each group of rows (none where by is null) and, under a null g, in all.

    Columns that clearly have more values in a group are told by sketches, a row a group, and take no part in the exact
    pass; nothing runs while this is planned."""
    texts = text_columns(df, columns)
    schema = "g string, idx int, value string, n long"
    if not texts:
        return df.sparkSession.createDataFrame([], schema)
    value = lambda c: F.when(~empty_of(df, c), col(c))
    none, places = F.lit(None).cast("string"), range(len(texts))
    rows = df.select((none if by is None else by).alias("g"), *[value(c).alias(f"v{i}") for i, c in enumerate(texts)])
    sketches = rows.groupBy("g").agg(*[F.hll_sketch_agg(f"v{i}").alias(f"n{i}") for i in places])
    both = sketches.select("g", *[f"n{i}" for i in places], F.explode(F.array_distinct(F.array("g", none))).alias("view"))
    rough = both.groupBy("view").agg(*[F.hll_sketch_estimate(F.hll_union_agg(f"n{i}")).alias(f"n{i}") for i in places])
    few = rough.select("view", F.array_compact(F.array(*[F.when(F.col(f"n{i}") <= 2 * most, F.lit(i)) for i in places])).alias("ks"))
    whole = few.filter("view is null").select(F.col("ks").alias("all"))
    few = few.filter("view is not null").select(F.col("view").alias("g"), F.col("ks").alias("own"))
    known = rows.crossJoin(F.broadcast(whole))  # one row
    known = known.join(F.broadcast(few), "g", "left") if by is not None else known.withColumn("own", F.array().cast("array<int>"))  # a row a group
    cells = known.select("g", "all", "own", F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.col(f"v{i}").alias("value")) for i in places])).alias("c")).filter("c.value is not null")
    cells = cells.select("g", "c.k", "c.value", F.array_contains("all", F.col("c.k")).alias("in_all"), F.coalesce(F.array_contains("own", F.col("c.k")), F.lit(False)).alias("in_own"))
    counted = cells.filter("in_all or in_own").groupBy("g", "k", "value", "in_all", "in_own").agg(F.count("*").alias("n"))
    views = F.array_compact(F.array(F.when(F.col("in_all"), F.struct(none.alias("g"))), F.when(F.col("in_own"), F.struct("g"))))
    part = counted.select(F.explode(views).alias("view"), "k", "value", "n").groupBy(F.col("view.g").alias("g"), "k", "value").agg(F.sum("n").alias("n"))
    kept = part.withColumn("values", F.count("*").over(Window.partitionBy("g", "k"))).filter(F.col("values") <= most)
    place = F.array(*[F.lit(columns.index(c)) for c in texts])[F.col("k")]
    return kept.select("g", place.alias("idx"), "value", "n")


def _near(x: Column, y: Column) -> Column:
    """Do two values (structs of value and norm) agree when normalised, or within two edits and a third of the longer?"""
    limit = F.least(F.lit(MAX_DISTANCE), F.floor(F.greatest(F.length(x["norm"]), F.length(y["norm"])) / 3))
    return (x["norm"] == y["norm"]) | ((limit >= 1) & (F.levenshtein(x["norm"], y["norm"]) <= limit))


def _paired(values: DataFrame, *keys: str) -> DataFrame:
    """The keys, total (values) and pairs (a, b), a < b, that are near, of each column: MAX_CATEGORIES values at most."""
    listed = values.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("value", normalize_category(F.col("value")).alias("norm")))).alias("v"))
    later = lambda x: F.filter("v", lambda y: (x["value"] < y["value"]) & _near(x, y))
    pairs = F.flatten(F.transform("v", lambda x: F.transform(later(x), lambda y: F.struct(x["value"].alias("a"), y["value"].alias("b")))))
    return listed.select(*keys, F.size("v").cast("long").alias("total"), pairs.alias("pairs"))


def _clustered(values: DataFrame, *keys: str) -> DataFrame:
    """The keys, total and clusters (arrays of values) of each column: pairs are taken one by one, and join what holds either."""
    kind = "array<array<string>>"

    def joined(sets: Column, p: Column) -> Column:
        of = lambda x: F.array_contains(x, p["a"]) | F.array_contains(x, p["b"])
        new = F.array_distinct(F.concat(F.array(p["a"], p["b"]), F.flatten(F.filter(sets, of))))
        return F.concat(F.filter(sets, lambda x: ~of(x)), F.array(new)).cast(kind)

    return _paired(values, *keys).select(*keys, "total", F.aggregate("pairs", F.array().cast(kind), joined).alias("clusters"))


def near_duplicate_pairs(values: DataFrame) -> DataFrame:
    """column, a, b: values of a column that agree when normalised or are within two edits (and a third of
    the longer one's length). A column has few values: category_values has seen to that."""
    return _paired(values, "column").select("column", F.explode("pairs").alias("p")).select("column", "p.*")


def category_clusters(values: DataFrame) -> DataFrame:
    """column, value, cluster (its least value)."""
    sets = _clustered(values, "column").select("column", F.explode("clusters").alias("c"))
    return sets.select("column", F.explode("c").alias("value"), F.array_min("c").alias("cluster"))


def inconsistent_categoricals(df: DataFrame, columns: list[str]) -> DataFrame:
    """A finding for every column with clusters: values in clusters, as a share of its distinct values."""
    return _inconsistent(_clustered(category_values(df, columns), "column", "idx")).select(*FINDING, "clusters")


def _inconsistent(clustered: DataFrame) -> DataFrame:
    found = clustered.filter(F.size("clusters") > 0).withColumns({"count": F.size(F.flatten("clusters")).cast("long"), "clusters": F.size("clusters").cast("long")})
    found = found.withColumn("percentage", percentage_of(F.col("count"), F.col("total")))
    severity = F.when(F.col("percentage") >= INCONSISTENT_ERROR, "error").otherwise("warning")
    return found.withColumns({"check_name": F.lit("inconsistent-categoricals"), "severity": severity})


def quality_report(df: DataFrame, columns: list[str], row_id: str = "row_id") -> DataFrame:
    """All findings of the four checks, in one shape, as a local table: a few rows a column, of passes over rows kept once."""
    return over_kept(df, lambda d: _findings(d, columns, row_id))


def _findings(df: DataFrame, columns: list[str], row_id: str) -> DataFrame:
    parts = (missing_values(df, columns), duplicate_rows(df, columns), inconsistent_categoricals(df, columns), mixed_types(df, columns, row_id))
    out = None
    for order, part in enumerate(parts):
        part = part.select(*FINDING).withColumn("check_order", F.lit(order))
        out = part if out is None else out.unionByName(part)
    return out


def _missing_by(df: DataFrame, columns: list[str], by: Column) -> DataFrame:
    empties = df.select(by.alias("g"), *[empty_of(df, c).alias(f"e{i}") for i, c in enumerate(columns)])
    counted = empties.rollup("g").agg(F.grouping("g").alias("whole"), F.count("*").alias("total"), *[F.count_if(f"e{i}").alias(f"n{i}") for i in range(len(columns))])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(i).alias("idx"), F.col(f"n{i}").alias("count")) for i, c in enumerate(columns)]))
    found = counted.filter("whole = 1 or g is not null").select("g", "total", each.alias("c")).select("g", "total", "c.*")
    found = found.withColumn("percentage", percentage_of(F.col("count"), F.col("total")))
    return found.withColumns({"check_name": F.lit("missing-values"), "severity": severity_of("missing-values", F.col("count"), F.col("percentage"))})


def _duplicates_by(df: DataFrame, columns: list[str], by: Column) -> DataFrame:
    """Copies within each group, and in all rows under a null group."""
    views = F.explode(F.array_distinct(F.array("_g", F.lit(None).cast("string")))).alias("_view")
    suspects = _suspects(df.withColumn("_g", by), columns).select(views, *map(col, columns))
    copies = suspects.groupBy("_view", *map(col, columns)).agg(F.count("*").alias("_copies")).filter("_copies > 1")
    extra = copies.groupBy(F.col("_view").alias("g")).agg(F.sum(F.col("_copies") - 1).alias("count"))
    totals = df.select(by.alias("g")).rollup("g").agg(F.grouping("g").alias("whole"), F.count("*").alias("total")).filter("whole = 1 or g is not null").select(F.col("g").alias("g2"), "total")
    found = totals.join(extra, F.col("g").eqNullSafe(F.col("g2")), "left").select(F.col("g2").alias("g"), "total", F.coalesce("count", F.lit(0).cast("long")).alias("count"))
    found = found.withColumn("percentage", percentage_of(F.col("count"), F.col("total")))
    return found.withColumns({"check_name": F.lit("duplicate-rows"), "column": F.lit(""), "idx": F.lit(-1), "severity": severity_of("duplicate-rows", F.col("count"), F.col("percentage"))})


def _mixed_by(df: DataFrame, columns: list[str], by: Column, row_id: str) -> DataFrame:
    texts = text_columns(df, columns)
    own = _bucketed(df, texts, row_id, by)
    views = F.explode(F.array_distinct(F.array("g", F.lit(None).cast("string")))).alias("view")
    both = own.select(views, "idx", "bucket", "n", "first_row").groupBy(F.col("view").alias("g"), "idx", "bucket").agg(F.sum("n").alias("n"), F.min("first_row").alias("first_row"))
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("g", "idx").orderBy(F.desc("n"), "first_row")))
    found = ranked.groupBy("g", "idx").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("rank") > 1, F.col("n")).otherwise(0)).alias("count"), F.count("*").alias("buckets")).filter("buckets > 1")
    place = F.array(*[F.lit(columns.index(c)) for c in texts])[F.col("idx")]
    found = found.withColumn("idx", place).withColumn("column", F.array(*map(F.lit, columns))[F.col("idx")]).withColumn("percentage", percentage_of(F.col("count"), F.col("total")))
    return found.withColumns({"check_name": F.lit("mixed-types"), "severity": severity_of("mixed-types", F.col("count"), F.col("percentage"))})


def quality_report_by(df: DataFrame, columns: list[str], by: Column, row_id: str = "row_id") -> DataFrame:
    """g and quality_report's columns: the report of each group of rows that by, a text, names, and, under a null g, of all
    rows; rows whose by is null are in the latter only. Each check is one pass for all groups, over rows kept once; its
    findings, a few rows a group and column, are a local table."""
    return over_kept(df, lambda d: _findings_by(d, columns, by, row_id))


def _findings_by(df: DataFrame, columns: list[str], by: Column, row_id: str) -> DataFrame:
    names = F.array(*map(F.lit, columns))
    clustered = _clustered(_grouped_values(df, columns, MAX_CATEGORIES, by), "g", "idx").withColumn("column", names[F.col("idx")])
    parts = [_missing_by(df, columns, by), _duplicates_by(df, columns, by), _inconsistent(clustered)]
    if text_columns(df, columns):
        parts.append(_mixed_by(df, columns, by, row_id))
    out = None
    for order, part in enumerate(parts):
        part = part.select("g", *FINDING).withColumn("check_order", F.lit(order))
        out = part if out is None else out.unionByName(part)
    return out


#: What a check counts, in the words of a finding's description.
COUNTED = {
    "missing-values": "empty cells", "duplicate-rows": "rows that repeat an earlier one", "inconsistent-categoricals": "values spelled in several ways",
    "mixed-types": "cells of another type than most",
}


def finding_details(report: DataFrame, columns: list[str]) -> DataFrame:
    """Findings that found something, with a description and the affected columns (all of them for duplicate rows)."""
    what = F.coalesce(*[F.when(F.col("check_name") == k, v) for k, v in COUNTED.items()])
    where = F.when(F.col("column") != "", F.concat(F.lit(" in "), "column")).otherwise("")
    text = F.concat(F.col("count").cast("string"), F.lit(" "), what, where, F.lit(" ("), F.round("percentage", 1).cast("string"), F.lit(" %)"))
    affected = F.when(F.col("column") == "", F.array(*map(F.lit, columns))).otherwise(F.array("column"))
    return report.filter("count > 0").withColumns({"description": text, "affected_columns": affected})


def cluster_samples(df: DataFrame, columns: list[str], k: int = SAMPLES) -> DataFrame:
    """column, place, sample: the first k clusters of spellings of each column, values joined by ' / '."""
    values = F.array_sort(F.collect_list("value"))  # a column has 49 values at most
    groups = category_clusters(category_values(df, columns)).groupBy("column", "cluster").agg(F.array_join(values, " / ").alias("sample"))
    return first_rows(groups, ["column"], [F.col("cluster")], k, "place").select("column", "place", "sample")


def finding_samples(df: DataFrame, columns: list[str], row_id: str = "row_id", k: int = SAMPLES) -> DataFrame:
    """check_name, column, place, sample: at most k examples of each finding: rows that repeat (cells joined by '|'),
    clusters of spellings, cells with their type. Missing cells have none."""
    row = F.concat_ws("|", *[F.coalesce(col(c).cast("string"), F.lit("")) for c in columns])
    copies = duplicate_samples(df, columns, row_id, k).select(F.lit("").alias("column"), F.row_number().over(Window.orderBy(col(row_id))).alias("place"), row.alias("sample"))  # k rows
    mixed = mixed_type_examples(df, columns, row_id, k).select("column", "place", F.concat("bucket", F.lit(": "), "value").alias("sample"))
    out = None
    for check, part in (("duplicate-rows", copies), ("inconsistent-categoricals", cluster_samples(df, columns, k)), ("mixed-types", mixed)):
        part = part.select(F.lit(check).alias("check_name"), "column", "place", "sample")
        out = part if out is None else out.unionByName(part)
    return out


def quality_concerns(report: DataFrame) -> DataFrame:
    return report.filter("severity <> 'info' and count > 0")


def quality_highlights(report: DataFrame, k: int = 10) -> DataFrame:
    """The k gravest findings that found something."""
    return report.filter("count > 0").orderBy(severity_rank(F.col("severity")), "check_order", "idx").limit(k)


def quality_totals(report: DataFrame, outliers: DataFrame) -> DataFrame:
    """One row: missing cells, columns with any, duplicates, outliers, and the worst severity."""
    of = lambda check: F.col("check_name") == check
    base = report.agg(
        F.sum(F.when(of("missing-values"), F.col("count")).otherwise(0)).alias("missing_cells"),
        F.count_if(of("missing-values") & (F.col("count") > 0)).alias("columns_missing"),
        F.sum(F.when(of("duplicate-rows"), F.col("count")).otherwise(0)).alias("duplicates"),
        F.min(F.when(F.col("count") > 0, severity_rank(F.col("severity")))).alias("worst"),
    )
    return base.crossJoin(outliers.agg(F.coalesce(F.sum("n_outliers"), F.lit(0)).alias("outliers")))  # one row by one row


def importance_sort(items: DataFrame, priority: str = "priority", order: str = "idx") -> DataFrame:
    """rank and the item's columns: high before medium before low; no priority counts as medium."""
    p = F.coalesce(F.col(priority), F.lit("medium"))
    grade = F.when(p == "high", 3).when(p == "medium", 2).when(p == "low", 1).otherwise(0)
    return items.withColumns({"grade": grade, priority: p}).orderBy(F.desc("grade"), order)


def item_bounds_check(items: DataFrame, bounds: dict[str, tuple[int, int]]) -> DataFrame:
    """group_id, type, n, bad (items without title or description, KPIs without a value) and within_bounds."""
    limits = items.sparkSession.createDataFrame([(k, *v) for k, v in bounds.items()], "type string, least int, most int")
    blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    bad = blank("title") | blank("description") | ((F.col("type") == "kpi") & F.col("value").isNull())
    counted = items.groupBy("group_id", "type").agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"))
    return counted.join(F.broadcast(limits), "type", "left").select(  # a row per type
        "group_id", "type", "n", "bad", F.coalesce(F.col("n").between(F.col("least"), F.col("most")), F.lit(False)).alias("within_bounds")
    )
