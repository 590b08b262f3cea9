"""What several operators of this package share: tables, the shared folder, durable cuts of lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD_GAP = r"[ \t-\r]+"
WORD_CHAR = r"[^ \t-\r]"


#: Rows of whole texts are long: so many travel to a Python worker at once, unless the session names its own number.
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession) -> None:
    if spark.conf.get(ARROW_ROWS) == "10000":
        spark.conf.set(ARROW_ROWS, "1000")


def named(name: str) -> str:
    """A column's name as an expression or a schema has it, whatever dots, blanks or backticks it holds."""
    return "`" + name.replace("`", "``") + "`"


def schema_of(df: DataFrame) -> str:
    return ", ".join(f"{named(f.name)} {f.dataType.simpleString()}" for f in df.schema.fields)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only where a session has none and runs
    in one process (tests on one machine), a new temporary folder; on a cluster that is an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not re.match(r"local($|\[)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        sc.setCheckpointDir(named)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named if "://" in named or named.startswith("file:") else f"file://{named}"


def saved(df: DataFrame) -> str:
    """The path of a table in the shared folder that holds df."""
    path = run_dir(df.sparkSession, "step")
    df.write.parquet(path)
    return path


def durable(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder, so that a lost executor costs no recomputation.

    A table rather than a checkpoint: a checkpoint keeps the estimates of the plan it replaces, which in a
    loop of joins grow by powers, and with them planning time and the driver's memory."""
    return df.sparkSession.read.schema(df.schema).parquet(saved(df))


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that nothing reads any more."""
    sc = spark.sparkContext
    for path in paths:
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def run_dir(spark: SparkSession, name: str) -> str:
    """A new folder of this run below the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
