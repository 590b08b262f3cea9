"""Tables of a few rows read their source once, however many passes they make."""

import pytest

from tableprobe.operators import calendar, dashboard, numeric, quality, report, structure
from tableprobe.operators.shape import over_kept

COLUMNS = ["s", "c", "n"]


@pytest.fixture
def counted(spark):
    """Twenty rows, and how many of them were computed so far."""
    made = spark.sparkContext.accumulator(0)

    def row(i):
        made.add(1)
        return i, f"S{i % 3}", ["web", "Web", "x y", f"2024-01-{1 + i % 9:02}"][i % 4], float(i)

    return spark.createDataFrame(spark.sparkContext.parallelize(range(20), 2).map(row), "row_id long, s string, c string, n double"), made


@pytest.mark.parametrize("make", [
    lambda d: dashboard.segment_notices(d, COLUMNS, ["n"], "s"),
    lambda d: quality.quality_report(d, COLUMNS),
    lambda d: quality.quality_report_by(d, COLUMNS, dashboard._category(d, "s")),
    lambda d: over_kept(d, lambda k: report.eda(k, structure.structural_profile(k, COLUMNS), "2024-12-31")),
    lambda d: over_kept(d, lambda k: quality.quality_totals(quality.quality_report(k, COLUMNS), numeric.outlier_counts(k, ["n"]))),
    lambda d: over_kept(d, lambda k: calendar.date_profile(k, ["c"], "2024-12-31")),
])
def test_rows_are_computed_once_and_let_go(counted, make):
    df, made = counted
    assert make(df).collect()
    assert made.value == 20
    assert not df.storageLevel.useMemory and not df.storageLevel.useDisk


def test_duplicates_take_one_wide_shuffle_of_suspects(spark):
    """Only hashes are shuffled before rows whose hash repeats are told: no join shuffles all rows."""
    rows = [(i, f"v{i}") for i in range(300)] + [(7, "v7"), (9, None), (9, None)]
    df = spark.createDataFrame(rows, "a int, b string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = quality.duplicate_groups(df, ["a", "b"])._jdf.queryExecution().executedPlan().toString()
        found = quality.duplicate_rows(df, ["a", "b"]).select("count", "groups").collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert [tuple(r) for r in found] == [(2, 2)]


def test_cells_of_groups_are_read_once(spark):
    df = spark.createDataFrame([(1, "S1", "x")], "row_id long, s string, c string")
    plan = quality._mixed_by(df, ["s", "c"], dashboard._category(df, "s"), "row_id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1
