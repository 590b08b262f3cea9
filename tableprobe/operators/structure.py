"""Structural profile: counts, inferred types, samples, tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprobe.functions.values import trimmed_class, typed_class
from tableprobe.operators.shape import filled_cells, first_cells

TYPE_SAMPLE, SAMPLES, MAJORITY = 200, 5, 0.7
# Industries and the words in column names that hint at them.
INDUSTRIES = {
    "retail / e-commerce": "sku|product|inventory|order|cart|price|discount|customer",
    "healthcare": "patient|diagnos|treatment|clinician|prescri|icd|admission",
    "finance / banking": "account|transaction|balance|invoice|payment|loan|interest|currency",
    "human resources": "employee|salary|hire|department|manager|payroll|headcount",
    "logistics / supply chain": "shipment|warehouse|carrier|tracking|freight|route|delivery",
    "marketing / sales": "campaign|lead|conversion|impression|click|revenue|deal|opportunity",
}


def table_stats(df: DataFrame, size_bytes: int | None = None) -> DataFrame:
    """n_rows, n_columns and, where the source's size is given (source_bytes), size_bytes."""
    found = df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)).cast("long"))
    return found if size_bytes is None else found.withColumn("size_bytes", F.lit(size_bytes).cast("long"))


def _type_from_counts(total) -> object:
    share = lambda *kinds: sum((F.coalesce(F.col(k), F.lit(0)) for k in kinds), F.lit(0)) / total >= MAJORITY
    return (
        F.when(total == 0, "null").when(share("boolean"), "boolean").when(share("integer"), "integer")
        .when(share("integer", "float"), "float").when(share("date"), "date").otherwise("string")
    )


def infer_types(df: DataFrame, columns: list[str], row_id: str = "row_id", sample: int | None = TYPE_SAMPLE) -> DataFrame:
    """column, idx and data_type by majority of the first values that are not empty (sample None: of all)."""
    seen = filled_cells(df, columns, row_id, typed_class) if sample is None else _first(df, columns, row_id, sample)
    return _typed(_kinds(df, columns, seen))


_KINDS = ("boolean", "integer", "float", "date")


def _typed(counted: DataFrame) -> DataFrame:
    return counted.select("column", "idx", _type_from_counts(F.coalesce(F.col("total"), F.lit(0))).alias("data_type"))


def _first(df: DataFrame, columns: list[str], row_id: str, k: int) -> DataFrame:
    return first_cells(df, columns, row_id, k, typed_class)


def _kinds(df: DataFrame, columns: list[str], seen: DataFrame) -> DataFrame:
    seen = seen.select("idx", F.coalesce("kind", trimmed_class(F.col("s"))).alias("kind"))
    found = seen.groupBy("idx").agg(F.count("*").alias("total"), *[F.count_if(F.col("kind") == k).alias(k) for k in _KINDS])
    return _names(df, columns).join(found, "idx", "left")


def _names(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.sparkSession.createDataFrame([(c, i) for i, c in enumerate(columns)], "column string, idx int")


def sample_values(df: DataFrame, columns: list[str], row_id: str = "row_id", k: int = SAMPLES) -> DataFrame:
    """column, idx, rank, value: the first values of each column that are not empty."""
    return _first(df, columns, row_id, k).join(_names(df, columns), "idx").select("column", "idx", "rank", F.col("text").alias("value"))


def structural_profile(df: DataFrame, columns: list[str], row_id: str = "row_id") -> DataFrame:
    """column, idx, data_type and samples (in order, joined by ' | ')."""
    seen = _first(df, columns, row_id, TYPE_SAMPLE)
    lists = seen.filter(F.col("rank") <= SAMPLES).groupBy("idx").agg(F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("s"))
    text = F.array_join(F.transform("s", lambda x: x["text"]), " | ")
    types = _typed(_kinds(df, columns, seen))
    return types.join(lists, "idx", "left").select("column", "idx", "data_type", F.coalesce(text, F.lit("")).alias("samples"))


def dictionary_tags(profile: DataFrame) -> DataFrame:
    """column and tags of a structural profile."""
    tags = F.array_compact(
        F.array(
            F.concat(F.lit("type:"), F.col("data_type")), F.when(F.col("data_type") == "null", "quality:all-null"), F.when(F.col("samples") == "", "quality:no-sample-values")
        )
    )
    return profile.select("column", "idx", tags.alias("tags"))


def structural_gaps(profile: DataFrame) -> DataFrame:
    return profile.filter("data_type = 'null'").select("column", "idx")


def industry_hints(df: DataFrame) -> DataFrame:
    """Industries whose words occur in the column names."""
    hints = df.sparkSession.createDataFrame(list(INDUSTRIES.items()), "industry string, words string")
    return hints.filter(F.regexp_like(F.lower(F.lit(" ".join(df.columns))), F.col("words"))).select("industry")


def tag_facets(items: DataFrame) -> DataFrame:
    return items.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n_items"))


def tag_filter(items: DataFrame, tags: list[str]) -> DataFrame:
    """Items that carry every one of the tags."""
    return items.filter(F.size(F.array_except(F.array(*map(F.lit, tags)), "tags")) == 0) if tags else items


def tag_union(items: DataFrame, more: str) -> DataFrame:
    """Items with the tags of another array column added, each tag once."""
    return items.withColumn("tags", F.array_union("tags", F.coalesce(F.col(more), F.array().cast("array<string>")))).drop(more)
