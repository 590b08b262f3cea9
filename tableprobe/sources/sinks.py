"""Sinks: CSV export and a catalog of profile runs as a partitioned Parquet table."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN = "dataset_id string, file_name string, uploaded_at timestamp, status string, n_rows long, report string"


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """Every row: quotes only where needed and doubled inside, null as empty, lines end with CR LF."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").options(header=True, escape='"', emptyValue="", nullValue="", lineSep="\r\n").csv(path)


def write_run(spark: SparkSession, path: str, dataset_id: str, file_name: str, n_rows: int, report: str, uploaded_at: datetime | None = None, status: str = "done") -> None:
    at = uploaded_at or datetime.now(timezone.utc)
    spark.createDataFrame([(dataset_id, file_name, at, status, n_rows, report)], RUN).write.mode("append").partitionBy("dataset_id").parquet(path)


def _runs(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(RUN).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], RUN)


def list_runs(spark: SparkSession, path: str) -> DataFrame:
    """dataset_id, file_name, uploaded_at, newest first; reports are not read."""
    return _runs(spark, path).select("dataset_id", "file_name", "uploaded_at").orderBy(F.desc("uploaded_at"))


def get_run(spark: SparkSession, path: str, dataset_id: str) -> DataFrame:
    """The run's row; only its partition is read."""
    return _runs(spark, path).filter(F.col("dataset_id") == dataset_id)


def update_run(spark: SparkSession, path: str, dataset_id: str, **patch) -> None:
    """Replaces the named fields of one run; KeyError if there is no such run."""
    rows = get_run(spark, path, dataset_id).collect()  # one row
    if not rows:
        raise KeyError(dataset_id)
    new = rows[0].asDict() | patch
    df = spark.createDataFrame([tuple(new[c.split()[0]] for c in RUN.split(", "))], RUN)
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset_id").parquet(path)


def delete_run(spark: SparkSession, path: str, dataset_id: str) -> None:
    """Removes one run; nothing happens if there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/dataset_id={dataset_id}")
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
