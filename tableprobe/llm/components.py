"""Connected components of a distributed edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprobe.llm.common import discard, saved

def _stars(edges: DataFrame) -> str:
    """One round over edges (a, b), a > b: each neighbour is linked to the least node that a node sees. Where it is saved.

    Least nodes are written before they are joined: a plain shuffled join, whose hot keys can be split."""
    spark, used = edges.sparkSession, []

    def step(df: DataFrame) -> DataFrame:
        used.append(saved(df))
        return spark.read.schema(df.schema).parquet(used[-1])

    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = step(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    large = step(both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b"))
    lower = step(large.groupBy("a").agg(F.min("b").alias("m")))
    ends = F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
    small = large.join(lower, "a").select(F.explode(ends).alias("e")).select("e.a", "e.b")
    out = saved(small.filter("a <> b").distinct())
    discard(spark, *used)
    return out


def connected_components(edges: DataFrame) -> DataFrame:
    """node and component (the least node it reaches) for every node of edges (a, b) that has another.

    Nodes may be of any type with an order. Null ends, loops and repeated edges are left out. Each round
    halves what is left at least; it ends when a round changes nothing."""
    spark = edges.sparkSession
    edges = edges.filter("a is not null and b is not null and a <> b")
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    schema, path = edges.schema, saved(edges)

    def state() -> tuple:
        return tuple(spark.read.schema(schema).parquet(path).agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = state()
    while before[0]:
        was, path = path, _stars(spark.read.schema(schema).parquet(path))
        discard(spark, was)
        after = state()
        if after == before:
            break
        before = after
    edges = spark.read.schema(schema).parquet(path)
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
