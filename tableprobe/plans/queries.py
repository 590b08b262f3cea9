"""The library's operators as queries over the given tables; oracle.py has their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableprobe.functions.values import csv_cell, markdown_cell, normalize_category, trimmed_class, typed_class
from tableprobe.operators import calendar, cleaning, dashboard, numeric, quality, report, structure
from tableprobe.operators.shape import filled_cells, over_kept
from tableprobe.plans.dirty import COLUMNS, dirty_orders
from tableprobe.plans.oracle import AS_OF
from tableprobe.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
NUMBERS = ["total_amount", "qty"]

PLAN = {
    "columns": [
        {
            "columnName": "channel",
            "valueMappings": [{"from": " Web ", "to": "web", "reason": "spacing"}, {"from": "WEB", "to": "web", "reason": "case"}, {"from": "Store", "to": "store", "reason": "case"}],
            "missingValuePolicy": {"action": "fill-default", "defaultValue": "unknown", "reason": "keeps the row"},
        },
        {"columnName": "status", "valueMappings": [{"from": "Fulfiled", "to": "Fulfilled", "reason": "typo"}]},
        {"columnName": "total_amount", "typeCoercion": {"targetType": "float", "reason": "amounts are numbers"}},
        {"columnName": "order_date", "typeCoercion": {"targetType": "date", "reason": "one format"}},
        {"columnName": "is_gift", "typeCoercion": {"targetType": "boolean", "reason": "one spelling"}},
        {"columnName": "segment_cd", "missingValuePolicy": {"action": "drop-row", "reason": "needed for segments"}},
        {"columnName": "notes", "missingValuePolicy": {"action": "leave-null", "reason": "unused"}},
        {"columnName": "no_such_column", "valueMappings": [{"from": "a", "to": "b", "reason": "absent"}]},
    ],
    "summary": "spellings, types and blanks of orders",
}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def on_orders(make: Callable[[DataFrame], DataFrame], name: str) -> None:
    """Registers what make does with the dirty orders."""
    QUERIES[name] = lambda spark, sf_dir: make(dirty_orders(spark, sf_dir))


def on_kept_orders(make: Callable[[DataFrame], DataFrame], name: str) -> None:
    """As on_orders, of makers of a few rows that read the orders several times: they are kept meanwhile."""
    on_orders(lambda d: over_kept(d, make), name)


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _stats(df: DataFrame) -> DataFrame:
    return _rounded(df, 4, *(c for c in numeric.STATS if c not in ("column", "idx", "n")))


def _report(d: DataFrame) -> DataFrame:
    return quality.quality_report(d, COLUMNS)


def _clean(d: DataFrame) -> tuple[DataFrame, DataFrame]:
    return cleaning.apply_cleaning_plan(d, cleaning.load_plan(PLAN))


def _classes(d: DataFrame) -> DataFrame:
    kind = F.coalesce("kind", trimmed_class(F.col("s"))).alias("class")
    found = filled_cells(d, COLUMNS, "row_id", typed_class).groupBy("idx", kind).agg(F.count("*").alias("n"))
    return found.select(F.array(*map(F.lit, COLUMNS))[F.col("idx")].alias("column"), "class", "n")


def _notices(d: DataFrame) -> DataFrame:
    return dashboard.dashboard_notices(_report(d), numeric.outlier_counts(d, NUMBERS), d.count())


def _detail(d: DataFrame) -> DataFrame:
    made = report.column_detail(
        structure.structural_profile(d, COLUMNS), numeric.numeric_describe(d, NUMBERS), calendar.date_profile(d, ["order_date"], AS_OF), _report(d)
    )
    return _rounded(made.select("column", "idx", "data_type", "samples", "mean", "earliest", "n_findings", "checks"), 4, "mean")


def _noted(d: DataFrame) -> DataFrame:
    profile = structure.structural_profile(d, COLUMNS)
    return report.column_structure_report(report.column_detail(profile, numeric.numeric_describe(d, NUMBERS), calendar.date_profile(d, ["order_date"], AS_OF), _report(d)))


def _eda(d: DataFrame) -> DataFrame:
    found = report.eda(_clean(d)[0], structure.structural_profile(d, COLUMNS), AS_OF)
    return _rounded(found.select("column", "idx", "data_type", "samples", "mean", "earliest", "n_findings", "checks"), 4, "mean")


def _attached(d: DataFrame) -> DataFrame:
    """Every other column's entry goes by a name that is no column's, and is found by its place."""
    profile = structure.structural_profile(d, COLUMNS)
    name = F.when(F.col("idx") % 2 == 0, F.col("column")).otherwise("unknown")
    return report.dictionary_attach(profile.select(name.alias("name"), F.col("idx").alias("place"), F.col("samples").alias("description")), profile)


def _tagged(d: DataFrame) -> DataFrame:
    more = F.array(F.lit("type:string"), F.lit("reviewed"))
    items = structure.tag_union(structure.dictionary_tags(structure.structural_profile(d, COLUMNS)).withColumn("more", more), "more")
    return items.withColumn("tags", F.array_join("tags", ","))


def _importance(d: DataFrame) -> DataFrame:
    graded = _report(d).withColumn("priority", F.when(F.col("severity") == "error", "high").when(F.col("severity") == "info", "low"))
    return quality.importance_sort(graded).select("check_name", "column", "priority", "grade")


def _bounds(d: DataFrame) -> DataFrame:
    items = _report(d).select(
        F.col("check_name").alias("group_id"), F.when(F.col("count") > 0, "kpi").otherwise("note").alias("type"), F.col("column").alias("title"),
        F.col("severity").alias("description"), F.col("count").alias("value"),
    )
    return quality.item_bounds_check(items, {"kpi": (1, 4), "note": (1, 9)})


def _charts(d: DataFrame) -> DataFrame:
    date = dashboard.choose_date_column(["order_date"])
    measure = dashboard.choose_measure_column([*NUMBERS, "age"])
    return _rounded(dashboard.choose_charts(d, date, ["segment_cd", "status"], measure), 2, "value")


def _cleaned(d: DataFrame) -> DataFrame:
    amount = F.coalesce(F.round(F.col("total_amount").try_cast("double"), 2), F.lit(-1.0)).alias("amount")
    return _clean(d)[0].select("row_id", "order_id", "channel", "status", "segment_cd", amount, "qty", "order_date", "is_gift", "notes")


def _typed(d: DataFrame) -> DataFrame:
    """Coerced columns with their types, and what could not be coerced beside them."""
    made = cleaning.apply_cleaning_plan(d, cleaning.load_plan(PLAN), typed=True)[0]
    amount = F.round("total_amount", 2).alias("total_amount")
    return made.select("row_id", "channel", amount, "total_amount_uncoerced", F.col("order_date").cast("string").alias("order_date"), "order_date_uncoerced", "is_gift", "is_gift_uncoerced")


def _compared(d: DataFrame) -> DataFrame:
    cleaned, audit = _clean(d)
    return cleaning.raw_vs_cleaned(d, cleaned, audit)


_FLAT = ("check_name", "column", "count", "percentage", "severity")
on_orders(structure.table_stats, "table_stats")
on_orders(_classes, "classify_values")
on_orders(lambda d: structure.infer_types(d, COLUMNS), "infer_types")
on_orders(lambda d: structure.sample_values(d, COLUMNS), "sample_values")
on_orders(lambda d: structure.structural_profile(d, COLUMNS), "structural_profile")
on_orders(lambda d: structure.structural_gaps(structure.structural_profile(d, COLUMNS)), "structural_gaps")
on_orders(lambda d: structure.dictionary_tags(structure.structural_profile(d, COLUMNS)).withColumn("tags", F.array_join("tags", ",")), "dictionary_tags")
on_orders(lambda d: structure.tag_facets(structure.dictionary_tags(structure.structural_profile(d, COLUMNS))), "tag_facets")
on_orders(lambda d: _rounded(quality.missing_values(d, COLUMNS), 6, "percentage"), "missing_values")
on_orders(lambda d: dashboard.ranked_by_count(quality.missing_values(d, COLUMNS)).select("column", "idx", "count"), "missing_ranked")
on_orders(lambda d: _rounded(quality.duplicate_rows(d, COLUMNS), 6, "percentage"), "duplicate_rows")
on_orders(lambda d: quality.duplicate_samples(d, COLUMNS).select("row_id", "order_id"), "duplicate_samples")
on_orders(lambda d: _rounded(quality.mixed_types(d, COLUMNS), 6, "percentage"), "mixed_types")
on_orders(lambda d: quality.mixed_type_examples(d, COLUMNS), "mixed_type_examples")
on_orders(lambda d: quality.category_values(d, COLUMNS), "category_values")
on_orders(lambda d: quality.near_duplicate_pairs(quality.category_values(d, COLUMNS)), "near_duplicate_pairs")
on_orders(lambda d: _rounded(quality.inconsistent_categoricals(d, COLUMNS), 6, "percentage"), "inconsistent_categoricals")
on_orders(lambda d: _rounded(_report(d), 6, "percentage"), "quality_report")
on_orders(lambda d: _rounded(quality.quality_highlights(_report(d)).select(*_FLAT), 6, "percentage"), "quality_highlights")
on_orders(lambda d: quality.quality_concerns(_report(d)).select("check_name", "column", "count"), "quality_concerns")
on_kept_orders(lambda d: quality.quality_totals(_report(d), numeric.outlier_counts(d, NUMBERS)), "quality_totals")
on_kept_orders(_notices, "dashboard_notices")
on_orders(lambda d: dashboard.segment_notices(d, COLUMNS, NUMBERS, "segment_cd"), "segment_notices")
on_orders(lambda d: _rounded(quality.quality_report_by(d, COLUMNS, dashboard._category(d, "segment_cd")), 6, "percentage").withColumnRenamed("g", "segment"), "segment_quality_report")
on_orders(lambda d: _stats(numeric.numeric_describe(d, NUMBERS)), "numeric_describe")
on_orders(lambda d: numeric.outlier_rows(d, NUMBERS), "outlier_rows")
on_orders(lambda d: _rounded(numeric.outlier_counts(d, NUMBERS), 6, "percentage"), "outlier_counts")
on_orders(lambda d: calendar.date_values(d, "order_date", AS_OF), "date_values")
on_orders(lambda d: calendar.flagged_dates(d, "order_date", AS_OF), "flagged_dates")
on_orders(lambda d: calendar.detect_date_columns(d, COLUMNS), "detect_date_columns")
on_orders(lambda d: calendar.date_profile(d, ["order_date"], AS_OF), "date_profile")
on_orders(lambda d: calendar.trend_monthly(d, "order_date"), "trend_monthly")
on_orders(_cleaned, "apply_cleaning_plan")
on_orders(_typed, "typed_cleaning_plan")
on_orders(lambda d: _clean(d)[1].drop("reason"), "audit_counts")
on_orders(lambda d: cleaning.cleaning_summary(_clean(d)[1]).drop("place"), "cleaning_summary")
on_orders(lambda d: cleaning.changed_columns(_clean(d)[1]), "changed_columns")
on_orders(_compared, "raw_vs_cleaned")
on_orders(lambda d: cleaning.preview(d).select("row_id", "order_id", "channel", "status"), "preview")
on_orders(lambda d: dashboard.filter_by_category(d, "channel", "Web").select("row_id", "channel"), "filter_by_category")
on_orders(lambda d: _rounded(dashboard.kpi_rows_in_view(dashboard.filter_by_category(d, "segment_cd", "S3"), d.count()), 6, "percentage"), "kpi_rows_in_view")
on_orders(lambda d: _rounded(_rounded(dashboard.kpi_measure(dashboard.filter_by_category(d, "segment_cd", "S3"), "total_amount"), 2, "total"), 4, "mean"), "kpi_measure")
on_orders(lambda d: _rounded(dashboard.kpi_top_category(d, "status"), 6, "percentage"), "kpi_top_category")
on_orders(lambda d: _rounded(_rounded(_rounded(dashboard.segment_kpis(d, "segment_cd", "total_amount"), 6, "percentage"), 2, "total"), 4, "mean"), "segment_kpis")
on_orders(lambda d: dashboard.distinct_categories(d, COLUMNS).withColumn("vals", F.array_join("vals", "|")), "distinct_categories")
on_orders(
    lambda d: dashboard.rank_filter_columns(dashboard.distinct_categories(d, COLUMNS), quality.inconsistent_categoricals(d, COLUMNS)).select("column", "n_values", "messiness", "rank"),
    "rank_filter_columns",
)
on_orders(_charts, "choose_charts")
on_orders(lambda d: d.select(normalize_category(F.col("channel")).alias("norm")).filter("norm <> ''").groupBy("norm").agg(F.count("*").alias("n")), "normalize_category")
on_kept_orders(_detail, "column_detail")
on_kept_orders(_noted, "column_structure_report")
on_kept_orders(_eda, "eda")
on_orders(_attached, "dictionary_attach")
on_orders(_tagged, "tag_union")
on_orders(lambda d: structure.tag_filter(structure.dictionary_tags(structure.structural_profile(d, COLUMNS)), ["type:string"]).select("column", "idx"), "tag_filter")
on_orders(lambda d: dashboard.ranked_by_count(numeric.outlier_counts(d, NUMBERS), "n_outliers").select("column", "idx", "n_outliers"), "outliers_ranked")
on_orders(
    lambda d: quality.finding_details(_report(d), COLUMNS).select("check_name", "column", "description", F.array_join("affected_columns", ",").alias("affected")), "finding_details"
)
on_orders(lambda d: quality.finding_samples(d, COLUMNS), "finding_samples")
on_orders(_importance, "importance_sort")
on_orders(_bounds, "item_bounds_check")


@query
def numeric_describe_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(numeric.numeric_describe(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), MEASURES))


@query
def exact_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return _rounded(numeric.exact_quantiles(lines, "l_extendedprice", [0.05, 0.5, 0.95]), 4, "value")


@query
def numeric_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(numeric.numeric_distribution(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_extendedprice"), 4, "lo", "hi")


@query
def typed_date_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = calendar.date_values(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderdate", AS_OF, "o_orderkey")
    return values.groupBy("normalized", "format").agg(F.count("*").alias("n"))


@query
def row_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read_table(spark, f"{sf_dir}/part.parquet", row_id="n").select("n", "p_partkey")


@query
def category_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.category_breakdown(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_brand", "p_partkey")


@query
def category_measure_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return _rounded(dashboard.category_measure_breakdown(lines, "l_returnflag", "l_extendedprice", "l_orderkey"), 2, "value")


@query
def escape_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", csv_cell(F.col("props")).alias("csv"), markdown_cell(F.col("props")).alias("markdown"))
