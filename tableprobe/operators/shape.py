"""Wide to long: a row per column, or per cell."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableprobe.functions.values import col, is_empty, trimmed


def per_column(df: DataFrame, columns: list[str], stats) -> DataFrame:
    """One aggregation of df, then a row per column: column, idx and what stats(name) names (name -> Column)."""
    aggs = [F.struct(*[v.alias(k) for k, v in stats(c).items()]).alias(f"s{i}") for i, c in enumerate(columns)]
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(i).alias("idx"), F.col(f"s{i}").alias("s")) for i, c in enumerate(columns)])
    return df.agg(*aggs).select(F.explode(rows).alias("r")).select("r.column", "r.idx", "r.s.*")


def held(df: DataFrame) -> DataFrame:
    """df's rows as a local table, computed once: for tables of a few rows a column, whatever the data."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def over_kept(df: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """make(df), a table of a few rows a column, as a local table: df's rows are computed once, kept in memory or on disk
    while make's passes read them, and let go. Within another such call, or where df is cached already, make(df) itself."""
    if df.storageLevel != StorageLevel.NONE:
        return make(df)
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        df.count()  # passes that run side by side would each compute the rows
        return held(make(df))
    finally:
        df.unpersist()


def cells(df: DataFrame, columns: list[str], row_id: str, value=None) -> DataFrame:
    """row_id, column, idx and value (a string, or what value(name) makes of a cell) of every cell."""
    value = value or (lambda c: col(c).cast("string"))
    parts = [F.struct(F.lit(c).alias("column"), F.lit(i).alias("idx"), value(c).alias("value")) for i, c in enumerate(columns)]
    return df.select(col(row_id).alias("row_id"), F.explode(F.array(*parts)).alias("c")).select("row_id", "c.*")


def first_rows(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark cuts each task's rows to k before it shuffles them."""
    from pyspark.sql import Window

    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= k)


def filled_cells(df: DataFrame, columns: list[str], row_id: str, typed, by: Column | None = None) -> DataFrame:
    """row_id, idx, kind, text and s, the text trimmed (and g, the row's group, with by), of every cell that is not empty. kind is typed(Column, type) for columns that hold no
    text, null for those that do: what is said of texts is then one expression, however many columns there are."""
    return long_cells(df, columns, row_id, typed, by).filter(F.col("kind").isNotNull() | (F.col("s") != ""))


def long_cells(df: DataFrame, columns: list[str], row_id: str, typed, by: Column | None = None) -> DataFrame:
    """filled_cells with the empty ones, whose kind is null and whose s is null or blank."""
    parts = []
    for i, c in enumerate(columns):
        kind, text = df.schema[c].dataType, col(c).cast("string")
        if isinstance(kind, T.StringType):
            parts.append(F.struct(F.lit(i).alias("idx"), F.lit(None).cast("string").alias("kind"), text.alias("text")))
        else:
            parts.append(F.struct(F.lit(i).alias("idx"), F.when(~is_empty(col(c), kind), typed(col(c), kind)).alias("kind"), text.alias("text")))
    group = [by.alias("g")] if by is not None else []
    long = df.select(col(row_id).alias("row_id"), *group, F.explode(F.array(*parts)).alias("c")).select("row_id", *(["g"] if group else []), "c.*")
    return long.withColumn("s", trimmed(F.col("text")))


def first_cells(df: DataFrame, columns: list[str], row_id: str, k: int, typed) -> DataFrame:
    """row_id, idx, kind, text and s (as filled_cells has them) and rank: the first k cells of each column that are not empty.

    Most columns have them among the first rows, which are cut out once (one small job tells which); only the cells
    of the others are ranked over the whole table."""
    named = df.select(col(row_id), *[col(c) for c in columns if c != row_id])
    head = named.orderBy(col(row_id)).limit(10 * k).persist()  # 10 * k rows
    told = {r["idx"]: r["n"] for r in filled_cells(head, columns, row_id, typed).groupBy("idx").agg(F.count("*").alias("n")).collect()}
    near = head.count() < 10 * k
    rest = [i for i in range(len(columns)) if not near and told.get(i, 0) < k]
    found = first_rows(filled_cells(head, columns, row_id, typed).filter(~F.col("idx").isin(rest)), ["idx"], [F.col("row_id")], k)
    if rest:
        far = filled_cells(named, [columns[i] for i in rest], row_id, typed).withColumn("idx", F.array(*map(F.lit, rest))[F.col("idx")])
        found = found.unionByName(first_rows(far, ["idx"], [F.col("row_id")], k))
    return found
