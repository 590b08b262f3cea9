"""Results joined for a reader: per column, as a summary, as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprobe.functions.values import markdown_cell, severity_rank
from tableprobe.operators import calendar, numeric, quality
from tableprobe.operators.shape import over_kept


def column_detail(profile: DataFrame, described: DataFrame, dates: DataFrame, report: DataFrame) -> DataFrame:
    """A row per column: type, samples, numbers, dates, findings that found something. All sides have a row or
    a few per column."""
    findings = report.filter("count > 0 and column <> ''").groupBy("column").agg(
        F.count("*").alias("n_findings"), F.min(severity_rank(F.col("severity"))).alias("worst"), F.array_join(F.array_sort(F.collect_set("check_name")), ", ").alias("checks")
    )
    return (
        profile.select("column", "idx", "data_type", "samples")
        .join(described.select("column", "min", "max", "mean"), "column", "left")
        .join(dates.select("column", "earliest", "latest"), "column", "left")
        .join(findings, "column", "left")
        .withColumns({"n_findings": F.coalesce("n_findings", F.lit(0)), "checks": F.coalesce("checks", F.lit(""))})
    )


def eda(cleaned: DataFrame, raw_profile: DataFrame, as_of: str, row_id: str = "row_id") -> DataFrame:
    """column_detail of the cleaned table under the raw table's profile: numbers are described where the raw type was a
    number, dates where most cleaned cells are dates, and the findings are the cleaned table's."""
    return over_kept(cleaned, lambda d: _eda(d, raw_profile, as_of, row_id))


def _eda(cleaned: DataFrame, raw_profile: DataFrame, as_of: str, row_id: str) -> DataFrame:
    raw = raw_profile.orderBy("idx").collect()  # a row per column
    columns = [r["column"] for r in raw]
    numbers = [r["column"] for r in raw if r["data_type"] in ("integer", "float")]
    dates = [r["column"] for r in calendar.detect_date_columns(cleaned, columns).filter("is_date").collect()]
    described = numeric.numeric_describe(cleaned, numbers or columns).filter(F.col("column").isin(numbers))
    spans = calendar.date_profile(cleaned, dates or columns, as_of).filter(F.col("column").isin(dates))
    return column_detail(raw_profile, described, spans, quality.quality_report(cleaned, columns, row_id))


def dictionary_attach(entries: DataFrame, profile: DataFrame) -> DataFrame:
    """Entries (name, place, description) with the real column's name and type: by name, else by place."""
    by_name = profile.select(F.col("column").alias("c1"), F.col("data_type").alias("t1"))
    by_place = profile.select(F.col("idx").alias("i2"), F.col("column").alias("c2"), F.col("data_type").alias("t2"))
    joined = entries.join(by_name, F.col("name") == F.col("c1"), "left").join(by_place, F.col("place") == F.col("i2"), "left")
    return joined.select("place", "description", F.coalesce("c1", "c2").alias("column"), F.when(F.col("c1").isNotNull(), F.col("t1")).otherwise(F.col("t2")).alias("data_type"))


def column_structure_report(detail: DataFrame) -> DataFrame:
    """column, idx, data_type, note: range and mean of numbers, else range of dates."""
    show = lambda c: F.round(c, 2).cast("string")
    numbers = F.concat_ws(" ", F.lit("mean"), show("mean"), F.lit("min"), show("min"), F.lit("max"), show("max"))
    spans = F.concat_ws(" ", F.col("earliest"), F.lit("to"), F.col("latest"))
    return detail.select("column", "idx", "data_type", F.when(F.col("earliest").isNotNull(), spans).when(F.col("mean").isNotNull(), numbers).otherwise("").alias("note"))


def analysis_summary(detail: DataFrame, highlights: DataFrame, n_rows: int) -> str:
    """JSON of columns (in order) and the gravest findings. Both tables are small: a row per column, ten rows."""
    import json

    columns = [r.asDict() for r in detail.orderBy("idx").collect()]
    findings = [r.asDict() for r in highlights.select("check_name", "column", "count", "percentage", "severity").collect()]
    return json.dumps({"n_rows": n_rows, "columns": columns, "findings": findings}, default=str)


def _table(df: DataFrame, names: list[str]) -> str:
    rows = df.select(*[markdown_cell(F.col(n)).alias(n) for n in names]).collect()
    lines = ["| " + " | ".join(names) + " |", "|" + " --- |" * len(names)]
    return "\n".join(lines + ["| " + " | ".join(r) + " |" for r in rows])


def assessment_report(title: str, n_rows: int, detail: DataFrame, report: DataFrame, audit: DataFrame | None = None) -> str:
    """Markdown of overview, structure, quality and, where there was a plan, the audit."""
    parts = [
        f"# {title}", f"{n_rows} rows, {len(detail.select('column').collect())} columns",
        "## Structure", _table(column_structure_report(detail).orderBy("idx"), ["column", "data_type", "note"]),
        "## Quality", _table(report.filter("count > 0").orderBy(severity_rank(F.col("severity")), "check_order", "idx"), ["check_name", "column", "count", "severity"]),
    ]
    if audit is not None:
        parts += ["## Cleaning", _table(audit.orderBy("seq"), ["column", "change_type", "detail", "affected_rows", "applied"])]
    return "\n\n".join(parts) + "\n"
