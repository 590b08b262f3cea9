"""Numeric columns: description, fences, outliers, distribution."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tableprobe.functions.values import coerce_to_number, col, percentage_of, severity_of, to_number
from tableprobe.operators.shape import held, over_kept, per_column

FENCE, BINS = 1.5, 6
QUARTERS = (0.25, 0.5, 0.75)
#: Numbers that a range of a column's values should hold, and ranges of a column at most.
RANGE_ROWS, MOST_RANGES = 1_000_000, 256
STATS = ("column", "idx", "n", "min", "max", "mean", "median", "mode", "stddev", "q1", "q3", "lo", "hi")


def _number(df: DataFrame, name: str):
    return to_number(col(name), df.schema[name].dataType)


def _numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """idx and x of every number."""
    cells = F.array(*[F.struct(F.lit(i).alias("idx"), _number(df, c).alias("x")) for i, c in enumerate(columns)])
    return df.select(F.explode(cells).alias("e")).select("e.idx", "e.x").filter("x is not null")


def _moments(df: DataFrame, columns: list[str], accuracy: int | None = None) -> list[Row]:
    """column, idx, n, min, max, mean, stddev and, with accuracy, q of each column with numbers: one job."""

    def stats(c):
        x = _number(df, c)
        found = {"n": F.count(x), "min": F.min(x), "max": F.max(x), "mean": F.avg(x), "stddev": F.coalesce(F.stddev_samp(x), F.lit(0.0))}
        return found | ({"q": F.percentile_approx(x, list(QUARTERS), accuracy)} if accuracy else {})

    return [r for r in per_column(df, columns, stats).collect() if r["n"]]


def _counts(numbers: DataFrame, *keys: str) -> DataFrame:
    """The keys, x and n: how often each number occurs."""
    return numbers.groupBy(*keys, "x").agg(F.count("*").alias("n"))


def _bounds(counts: DataFrame, known: dict[int, int]) -> dict[int, list[float]]:
    """Of the idx that have many distinct numbers: the bounds of ranges of about RANGE_ROWS of them, from sketches."""
    if not (several := [i for i, n in known.items() if n > RANGE_ROWS]):
        return {}
    sizes = {r["idx"]: r["k"] for r in counts.filter(F.col("idx").isin(several)).groupBy("idx").agg(F.count("*").alias("k")).collect()}  # a row per idx
    large = {i: min(MOST_RANGES, math.ceil(k / RANGE_ROWS)) for i, k in sizes.items() if k > RANGE_ROWS}
    if not large:
        return {}
    grid = [k / MOST_RANGES for k in range(1, MOST_RANGES)]
    found = counts.filter(F.col("idx").isin(list(large))).groupBy("idx").agg(F.percentile_approx("x", grid, 1000).alias("b")).collect()  # a row per idx
    return {r["idx"]: sorted({r["b"][k * MOST_RANGES // large[r["idx"]] - 1] for k in range(1, large[r["idx"]])}) for r in found}


def _ranked(counts: DataFrame, known: dict[int, int], shares: tuple[float, ...]) -> DataFrame:
    """idx, q (the interpolated quantile of each share) and mode (a tied one is the least) of numbers counted (idx, x, n), of
    which known tells how many each idx has: distinct values are ranked within ranges of values, so that no task holds all
    of a large one."""
    cut = _bounds(counts, known)
    bounds = lambda i: F.array(*map(F.lit, cut[i])) if cut.get(i) else F.array().cast("array<double>")
    each = lambda value: F.create_map(*[x for i in known for x in (F.lit(i), value(i))])[F.col("idx")]
    ranged = counts.withColumn("part", F.size(F.filter(each(bounds), lambda b: b < F.col("x"))))
    before = Window.partitionBy("idx").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    starts = ranged.groupBy("idx", "part").agg(F.sum("n").alias("size")).select("idx", "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("idx", "part").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumn("upto", F.sum("n").over(within)).join(F.broadcast(starts), ["idx", "part"])  # MOST_RANGES rows an idx
    after = F.col("start") + F.col("upto")
    placed = placed.select("idx", "x", "n", (after - F.col("n")).alias("first"), (after - 1).alias("last"), each(lambda i: F.lit(known[i])).alias("total"))
    at = [(F.col("total") - 1) * F.lit(float(s)) for s in shares]
    low = [F.max(F.when(F.col("first") <= F.floor(a), F.col("x"))).alias(f"low{k}") for k, a in enumerate(at)]
    high = [F.min(F.when(F.col("last") >= F.ceil(a), F.col("x"))).alias(f"high{k}") for k, a in enumerate(at)]
    found = placed.groupBy("idx", "total").agg(*low, *high, F.min(F.struct((-F.col("n")).alias("n"), "x"))["x"].alias("mode"))
    share = [a - F.floor(a) for a in at]  # of the way from low to high
    value = [(1 - f) * F.col(f"low{k}") + f * F.col(f"high{k}") for k, f in enumerate(share)]
    return found.select("idx", F.array(*value).alias("q"), "mode")


def numeric_describe(df: DataFrame, columns: list[str], accuracy: int | None = None) -> DataFrame:
    """A row per column over its finite numbers; quantiles are interpolated, a tied mode is the least value. It
    runs at once: a pass for the moments, and one that counts distinct values, which are kept while they are ranked.

    With accuracy, quantiles are percentile_approx of that accuracy."""
    known = _moments(df, columns, accuracy)
    spark, fields = df.sparkSession, ("column", "idx", "n", "min", "max", "mean", "stddev")
    schema = "column string, idx int, n long, min double, max double, mean double, stddev double, rough array<double>"
    base = spark.createDataFrame([(*[r[f] for f in fields], r["q"] if accuracy else None) for r in known], schema)
    if not known:
        return base.withColumns({c: F.lit(None).cast("double") for c in STATS if c not in fields}).select(*STATS)
    ranked = over_kept(_counts(_numbers(df, columns), "idx"), lambda c: _ranked(c, {r["idx"]: r["n"] for r in known}, QUARTERS))
    found = base.join(ranked, "idx").withColumn("q", F.coalesce("rough", "q"))
    found = found.withColumns({"q1": F.col("q")[0], "median": F.col("q")[1], "q3": F.col("q")[2]})
    reach = FENCE * (F.col("q3") - F.col("q1"))
    found = found.withColumns({"lo": F.col("q1") - reach, "hi": F.col("q3") + reach})
    return found.withColumn("stddev", F.when(F.col("n") < 2, 0.0).otherwise(F.col("stddev"))).select(*STATS)


def exact_quantiles(df: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """share and value, interpolated; none where the column has no numbers."""
    known = _moments(df, [column])
    if not known or not shares:
        return df.sparkSession.createDataFrame([], "share double, value double")
    pairs = F.arrays_zip(F.array(*[F.lit(float(s)) for s in shares]).alias("share"), F.col("q").alias("value"))
    ranked = over_kept(_counts(_numbers(df, [column]), "idx"), lambda c: _ranked(c, {0: known[0]["n"]}, tuple(shares)))
    return ranked.select(F.explode(pairs).alias("e")).select("e.share", "e.value")


def outlier_rows(df: DataFrame, columns: list[str], row_id: str = "row_id", described: DataFrame | None = None) -> DataFrame:
    """column, row_id, value of numbers strictly outside their column's fences. All fences are one row, and rows are long
    only where they have outliers."""
    fences = (described if described is not None else numeric_describe(df, columns)).select("column", "lo", "hi")
    row = fences.agg(*[F.max(F.when(F.col("column") == c, F.struct("lo", "hi"))).alias(f"f{i}") for i, c in enumerate(columns)])
    numbers = df.select(col(row_id).alias("row_id"), *[_number(df, c).alias(f"x{i}") for i, c in enumerate(columns)]).crossJoin(F.broadcast(row))  # one row
    out = lambda i: (F.col(f"x{i}") < F.col(f"f{i}.lo")) | (F.col(f"x{i}") > F.col(f"f{i}.hi"))
    hits = F.array_compact(F.array(*[F.when(out(i), F.struct(F.lit(c).alias("column"), F.col(f"x{i}").alias("value"))) for i, c in enumerate(columns)]))
    return numbers.select("row_id", F.explode(hits).alias("h")).select("h.column", "row_id", "h.value")


def outlier_counts_by(df: DataFrame, columns: list[str], by: Column, groups: list[str]) -> DataFrame:
    """g, column, idx, n_outliers, percentage, severity: outlier_counts of each of the groups of rows that by names, by its own
    fences, and, under a null g, of all rows. Numbers are counted in one pass over the rows; the rest reads the counts."""
    width, place = len(columns), F.coalesce(F.array_position(F.array(*map(F.lit, groups)).cast("array<string>"), by), F.lit(0))
    numbers = df.select(place.cast("int").alias("p"), F.explode(F.array(*[F.struct(F.lit(i).alias("i"), _number(df, c).alias("x")) for i, c in enumerate(columns)])).alias("e"))
    own = _counts(numbers.filter("e.x is not null").select("p", "e.i", "e.x"), "p", "i")
    keys = F.array_distinct(F.array(F.col("i"), F.col("p") * width + F.col("i")))  # of all rows, and of the group
    counts = own.select(F.explode(keys).alias("idx"), "x", "n").groupBy("idx", "x").agg(F.sum("n").alias("n"))
    return over_kept(counts, lambda c: _outliers_by(c, columns, groups))


def _outliers_by(counts: DataFrame, columns: list[str], groups: list[str]) -> DataFrame:
    width = len(columns)
    known = {r["idx"]: r["n"] for r in counts.groupBy("idx").agg(F.sum("n").alias("n")).collect()}  # groups times columns
    schema = "g string, column string, idx int, n_outliers long, percentage double, severity string"
    if not known:
        return counts.sparkSession.createDataFrame([], schema)
    q = F.col("q")
    reach = FENCE * (q[1] - q[0])
    fences = _ranked(counts, known, (QUARTERS[0], QUARTERS[2])).select("idx", (q[0] - reach).alias("lo"), (q[1] + reach).alias("hi"))
    out = (F.col("x") < F.col("lo")) | (F.col("x") > F.col("hi"))
    counted = counts.join(F.broadcast(fences), "idx").groupBy("idx").agg(F.sum("n").alias("n"), F.sum(F.when(out, F.col("n")).otherwise(0)).alias("n_outliers"))
    found = counted.withColumn("percentage", percentage_of(F.col("n_outliers"), F.col("n")))
    found = found.withColumn("severity", severity_of("outliers", F.col("n_outliers"), F.col("percentage")))
    g = F.get(F.array(F.lit(None).cast("string"), *map(F.lit, groups)), F.floor(F.col("idx") / width).cast("int"))
    i = F.col("idx") % width
    return found.select(g.alias("g"), F.get(F.array(*map(F.lit, columns)), i).alias("column"), i.alias("idx"), "n_outliers", "percentage", "severity")


def outlier_counts(df: DataFrame, columns: list[str], row_id: str = "row_id") -> DataFrame:
    """column, idx, n_outliers, percentage, severity of every column with numbers, in no order."""
    described = held(numeric_describe(df, columns))  # a row per column
    n = outlier_rows(df, columns, row_id, described).groupBy("column").agg(F.count("*").alias("n_outliers"))
    found = described.join(n, "column", "left").withColumn("n_outliers", F.coalesce("n_outliers", F.lit(0)))
    found = found.withColumn("percentage", percentage_of(F.col("n_outliers"), F.col("n")))
    found = found.withColumn("severity", severity_of("outliers", F.col("n_outliers"), F.col("percentage")))
    return found.select("column", "idx", "n_outliers", "percentage", "severity")


def numeric_distribution(df: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """bin, lo, hi, n: bins of equal width from least to greatest, the last one closed; one bin where all agree."""
    x = df.select(coerce_to_number(col(column), df.schema[column].dataType).alias("x")).filter("x is not null")
    ends = x.agg(F.min("x").alias("least"), F.max("x").alias("most")).filter("least is not null").withColumn("width", (F.col("most") - F.col("least")) / bins)
    place = F.when(F.col("width") == 0, 0).otherwise(F.least(F.lit(bins - 1), F.floor(F.try_divide(F.col("x") - F.col("least"), F.col("width"))))).cast("int")
    counts = x.crossJoin(F.broadcast(ends)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))  # one row
    frame = ends.select(F.explode(F.when(F.col("width") == 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(bins - 1)))).alias("bin"), "least", "most", "width")
    last = (F.col("bin") == bins - 1) | (F.col("width") == 0)
    return frame.join(counts, "bin", "left").select(
        "bin", (F.col("least") + F.col("bin") * F.col("width")).alias("lo"),
        F.when(last, F.col("most")).otherwise(F.col("least") + (F.col("bin") + 1) * F.col("width")).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"),
    )
