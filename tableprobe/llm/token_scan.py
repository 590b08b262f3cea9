"""Token counts by a separator scan of flat token files without an index.

``write_token_files`` writes documents as bare identifiers, each followed by the end-of-document identifier;
``scan`` reads such files in blocks by range, finds separators with one vectorised comparison per block, and
stitches documents that cross blocks with a prefix scan over the blocks' counts and last separators.

Defined cases: an empty or null text is a document of zero tokens; tokens after the last separator are
reported as a document that is not terminated; empty files and tables give no rows; special-token strings
in a text are ordinary text, so the separator occurs nowhere else.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tableprobe.llm.common import durable
from tableprobe.llm.tokens import word_encoder


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, dtype: str = "<u2", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes one file per task into folder; returns doc_id, file and ordinal of each document. A task that
    runs again writes the same file again, under a name of its own until it is whole."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = word_encoder(tokenizer_path, True), np.array([end_id], dtype).tobytes()
        store, top = pafs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        task, n = TaskContext.get(), 0
        name = f"tokens-{task.partitionId():06d}.bin"
        part = f"{top}/.{name}-{task.taskAttemptId()}"
        with store.open_output_stream(part) as out:
            for batch in batches:
                for ids in encode(batch.column(1).to_pylist()):
                    out.write(ids.astype(dtype).tobytes() + end)
                rows = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([name] * rows), pa.array(range(n, n + rows), "int64")], ["doc_id", "file", "ordinal"]
                )
                n += rows
        store.move(part, f"{top}/{name}")

    return durable(docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"doc_id {kind}, file string, ordinal long"))


def token_files(spark: SparkSession, folder: str) -> DataFrame:
    """file and bytes of the folder's token files."""
    store, top = pafs.FileSystem.from_uri(folder)
    found = store.get_file_info(pafs.FileSelector(top, allow_not_found=True))
    rows = [(x.base_name, x.size) for x in found if x.type == pafs.FileType.File and x.base_name.startswith("tokens-")]
    return spark.createDataFrame(rows, "file string, bytes long")


def blocks(files: DataFrame, width: int, block_tokens: int, task_bytes: int) -> DataFrame:
    """file, bytes and block of every block of tokens of so many bytes, dealt to so many tasks that each reads about
    task_bytes: the rows themselves are too small for adaptive planning to tell."""
    files = files.filter("bytes > 0")
    total = files.agg(F.sum("bytes")).first()[0] or 0
    found = files.select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / (width * block_tokens)))).alias("block"))
    return found.repartition(max(1, math.ceil(total / task_bytes)), "file", "block")


def scan(files: DataFrame, folder: str, end_id: int, dtype: str = "<u2", block_tokens: int = 1 << 22, task_bytes: int = 16 << 20) -> DataFrame:
    """file, ordinal, start (token of the file), n_tokens (without the separator) and terminated."""
    width = np.dtype(dtype).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                at = row["block"] * block_tokens
                with store.open_input_file(f"{top}/{row['file']}") as f:
                    data = f.read_at(min(width * block_tokens, row["bytes"] - width * at), width * at)
                ends = at + np.flatnonzero(np.frombuffer(data, dtype) == end_id)
                before = pa.array(np.r_[-1, ends[:-1]] if len(ends) else ends, "int64", mask=np.arange(len(ends)) == 0)
                n = len(ends)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["file"]] * n, "string"), pa.array([row["block"]] * n, "int64"), pa.array(np.arange(n)), pa.array(ends, "int64"), before],
                    ["file", "block", "k", "end", "before"],
                )

    found = durable(blocks(files, width, block_tokens, task_bytes).mapInArrow(run, "file string, block long, k long, end long, before long"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    prefix = found.groupBy("file", "block").agg(F.count("*").alias("n"), F.max("end").alias("last")).select(
        "file", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"), F.coalesce(F.max("last").over(earlier), F.lit(-1)).alias("carry")
    )
    start = F.coalesce("before", "carry") + 1
    whole = found.join(prefix, ["file", "block"]).select(
        "file", (F.col("base") + F.col("k")).alias("ordinal"), start.alias("start"), (F.col("end") - start).alias("n_tokens"), F.lit(True).alias("terminated")
    )
    seen = found.groupBy("file").agg(F.count("*").alias("n"), F.max("end").alias("last"))
    after = F.coalesce(F.col("last"), F.lit(-1)) + 1
    tail = files.filter("bytes > 0").join(seen, "file", "left").select(
        "file", F.coalesce("n", F.lit(0)).alias("ordinal"), after.alias("start"), (F.col("bytes") / width).cast("long").alias("total"), F.lit(False).alias("terminated")
    ).filter("total > start").select("file", "ordinal", "start", (F.col("total") - F.col("start")).alias("n_tokens"), "terminated")
    return whole.unionByName(tail)
