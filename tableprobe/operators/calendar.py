"""Date columns: which they are, what they span, what is odd in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprobe.functions.dates import DATE_SHARE, date_flag, month_of, normalized_date, parse_date
from tableprobe.functions.values import col, empty_of
from tableprobe.operators.shape import per_column


def _parsed(df: DataFrame, name: str):
    return parse_date(col(name), df.schema[name].dataType)


def detect_date_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, idx, n_parsed, n_filled, is_date."""
    found = per_column(df, columns, lambda c: {"n_parsed": F.count_if(_parsed(df, c).isNotNull()), "n_filled": F.count_if(~empty_of(df, c))})
    return found.withColumn("is_date", F.coalesce(F.try_divide(F.col("n_parsed"), F.col("n_filled")) >= DATE_SHARE, F.lit(False)))


def date_values(df: DataFrame, column: str, as_of: str, row_id: str = "row_id") -> DataFrame:
    """row_id, original, normalized, format and flag of every row, in the row's own partition."""
    p = F.col("p")
    return df.select(col(row_id).alias("row_id"), col(column).cast("string").alias("original"), _parsed(df, column).alias("p")).select(
        "row_id", "original", normalized_date(p).alias("normalized"), p["format"].alias("format"), date_flag(p, as_of).alias("flag")
    )


def flagged_dates(df: DataFrame, column: str, as_of: str, row_id: str = "row_id") -> DataFrame:
    return date_values(df, column, as_of, row_id).filter("flag is not null").select("row_id", "original", "normalized", F.col("flag").alias("reason"))


def date_profile(df: DataFrame, columns: list[str], as_of: str) -> DataFrame:
    """column, idx, earliest, latest, duration_days, formats (sorted, joined by ', ') and n_flagged."""

    days = df.select(*[_parsed(df, c).alias(c) for c in columns])  # a cell is parsed once, though four figures are taken from it

    def stats(c):
        p = col(c)
        return {"earliest": F.min(p["day"]), "latest": F.max(p["day"]), "f": F.collect_set(p["format"]), "n_flagged": F.count_if(date_flag(p, as_of).isNotNull())}

    found = per_column(days, columns, stats).filter("earliest is not null")
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return found.select("column", "idx", day("earliest"), day("latest"), F.datediff("latest", "earliest").alias("duration_days"), F.array_join(F.array_sort("f"), ", ").alias("formats"), "n_flagged")


def trend_monthly(df: DataFrame, column: str) -> DataFrame:
    """month and n, in order."""
    return df.select(month_of(_parsed(df, column)).alias("month")).filter("month is not null").groupBy("month").agg(F.count("*").alias("n")).orderBy("month")
