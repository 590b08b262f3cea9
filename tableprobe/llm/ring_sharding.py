"""Consistent-hash ring with virtual nodes and bounded loads.

A ring of ``cells`` places carries ``vnodes`` virtual nodes per shard. A key belongs to the first virtual
node clockwise of its cell. Every shard has a load bound; keys that overflow a full shard continue
clockwise to the next shard with room. All keys of a cell see the shards in the same order, so who overflows
is settled on the ``cells`` counts (a table of fixed size, whatever the data) and each row then finds its
place by its rank in its cell. With bounds of floor or ceiling of rows / shards the law is ``rows``: counts
differ by one at most.

Ranks come from two levels, sub-buckets of a cell and rows within, so no cell, key or group of equal rows
meets in one task: equal rows are counted before the shuffle and dealt out in chunks.

Defined cases: a null doc_id is a key like any other; a null text has no bytes; rows that agree in doc_id,
size and checksum are interchangeable and get consecutive places of their chunk; an empty table gives no
rows. Copies of a text have different keys and are not held together.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tableprobe.llm.common import durable

CELLS = 4096
#: Rows that a sub-bucket should hold, and equal rows that stay together.
BUCKET_ROWS = 4096
CHUNK = 1024


def shard_orders(n_shards: int, vnodes: int, cells: int = CELLS) -> list[list[int]]:
    """For every cell, all shards in the order in which their virtual nodes come clockwise."""
    nodes = []
    for shard in range(n_shards):
        for v in range(vnodes):
            h = int.from_bytes(hashlib.blake2b(f"{shard}/{v}".encode(), digest_size=8).digest(), "big")
            nodes.append((h % cells, h, shard))
    nodes.sort()
    at, orders = 0, []
    for cell in range(cells):
        while at < len(nodes) and nodes[at][0] < cell:
            at += 1
        order: dict[int, None] = {}
        for k in range(len(nodes)):
            order[nodes[(at + k) % len(nodes)][2]] = None
            if len(order) == n_shards:
                break
        orders.append(list(order))
    return orders


def spill_plan(counts: dict[int, int], orders: list[list[int]], bounds: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, rank after the last, shard, slot of the first): where a cell's keys go when each
    shard takes at most its bound and the others continue clockwise."""
    room, filled, placed, plan = list(bounds), [0] * len(bounds), dict.fromkeys(counts, 0), []
    for turn in range(len(bounds)):
        for cell in sorted(counts):
            shard = orders[cell][turn]
            take = min(counts[cell] - placed[cell], room[shard])
            if take > 0:
                plan.append((cell, placed[cell], placed[cell] + take, shard, filled[shard]))
                placed[cell] += take
                room[shard] -= take
                filled[shard] += take
    return plan


def assign(docs: DataFrame, n_shards: int = 8, vnodes: int = 64, cells: int = CELLS, slack: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, home_shard (that of the ring without bounds) per row.

    slack 0 bounds loads by floor or ceiling of the mean; slack 0.25 lets a shard take 1.25 times the mean
    and moves fewer keys."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    equal = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    chunks = equal.select(
        "doc_id", "size", "text_crc32", "n",
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK))).alias("chunk"),
    ).select(
        "doc_id", "size", "text_crc32", "chunk",
        F.least(F.lit(CHUNK).cast("long"), F.col("n") - F.col("chunk") * CHUNK).alias("n"),
        F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - int(math.log2(cells))).cast("int").alias("cell"),
        F.xxhash64("doc_id", "size", "text_crc32", "chunk").alias("h"),
    )
    chunks = durable(chunks)
    counts = {r["cell"]: r["n"] for r in chunks.groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    total = sum(counts.values())
    if slack:
        bounds = [math.ceil((1 + slack) * total / n_shards)] * n_shards
    else:
        bounds = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    orders = shard_orders(n_shards, vnodes, cells)
    plan = spark.createDataFrame(
        [(*p, orders[p[0]][0]) for p in spill_plan(counts, orders, bounds)],
        "cell int, lo long, hi long, shard int, base long, home_shard int",
    )
    n_sub = 1 << max(0, math.ceil(math.log2(max(1, total / cells / BUCKET_ROWS))))
    bucketed = chunks.withColumn("sub", F.pmod(F.col("h"), F.lit(n_sub)).cast("int"))
    before = Window.partitionBy("cell").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        bucketed.groupBy("cell", "sub").agg(F.sum("n").alias("in_bucket"))
        .select("cell", "sub", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("start"))
    )
    within = Window.partitionBy("cell", "sub").orderBy("h", "doc_id", "size", "text_crc32", "chunk")
    ranked = (
        bucketed.withColumn("place", F.sum("n").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
        .join(starts, ["cell", "sub"])
        .withColumn("rank", F.explode(F.sequence(F.col("start") + F.col("place"), F.col("start") + F.col("place") + F.col("n") - 1)))
    )
    # The plan has at most cells * n_shards rows, however large the input: safe to broadcast.
    here = (F.col("p.cell") == F.col("k.cell")) & (F.col("k.rank") >= F.col("p.lo")) & (F.col("k.rank") < F.col("p.hi"))
    return ranked.alias("k").join(F.broadcast(plan).alias("p"), here).select(
        "k.doc_id", "k.size", "k.text_crc32", "p.shard", (F.col("p.base") + F.col("k.rank") - F.col("p.lo")).alias("slot"), "p.home_shard",
    )
