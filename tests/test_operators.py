"""Planted issues on tiny frames, and the edge cases: no rows, one row, nothing but blanks."""

import json

import pytest
from pyspark.sql import functions as F

from tableprobe.functions import dates, values
from tableprobe.operators import calendar, cleaning, dashboard, numeric, quality, report, structure


def one_column(spark, cells, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(cells)], f"row_id long, v {kind}")


def test_classes_of_values(spark):
    cells = ["true", "YES", "no", "1", "-7", "3.14", ".5", "1e5", "0x1F", "1d", "NaN", "2024-01-31", "13/01/2024", "02/30/2024", "abc", " \t ", None]
    got = [tuple(r) for r in one_column(spark, cells).orderBy("row_id").select(values.classify_value(F.col("v")), values.classify_bucket(F.col("v"))).collect()]
    fine = ["boolean"] * 3 + ["integer"] * 2 + ["float"] * 2 + ["string"] * 4 + ["date", "string", "date", "string", None, None]
    coarse = ["boolean"] * 3 + ["number"] * 5 + ["string"] * 3 + ["date", "string", "date", "string", None, None]
    assert got == list(zip(fine, coarse, strict=True))


def test_dates(spark):
    cells = ["03/04/2024", "25/12/2024", "12/25/24", "1/1/69", "1.2.3", "2024/3/4", "2024-02-30", "2024-01-31T10:00:00Z", "January 5, 2024", "5 Jan 2024", "ORD-50276", "SKU-2024", "", None]
    p = dates.parse_date(F.col("v"))
    got = [tuple(r) for r in one_column(spark, cells).orderBy("row_id").select(dates.normalized_date(p), p["format"]).collect()]
    assert got == [
        ("2024-03-04", "US-slash"), ("2024-12-25", "EU-slash"), ("2024-12-25", "US-slash"), ("1969-01-01", "US-slash"), ("2003-01-02", "US-slash"),
        ("2024-03-04", "ISO-like-slash"), (None, None), ("2024-01-31", "ISO-8601"), ("2024-01-05", "Other"), ("2024-01-05", "Other"),
        (None, None), (None, None), (None, None), (None, None),
    ]


def test_numbers(spark):
    row = numeric.numeric_describe(one_column(spark, [1.0, 2.0, 2.0, 5.0, 5.0, 9.0, float("nan")], "double"), ["v"]).first()
    assert (row["n"], row["median"], row["q1"], row["q3"], row["mode"]) == (6, 3.5, 2.0, 5.0, 2.0)
    single = numeric.numeric_describe(one_column(spark, [3.0], "double"), ["v"]).first()
    assert (single["stddev"], single["median"]) == (0.0, 3.0)
    assert numeric.numeric_describe(one_column(spark, [], "double"), ["v"]).count() == 0
    assert [tuple(r) for r in numeric.numeric_distribution(one_column(spark, [2.0, 2.0], "double"), "v").collect()] == [(0, 2.0, 2.0, 2)]
    assert numeric.numeric_distribution(one_column(spark, [], "double"), "v").count() == 0


def test_ranges_of_values_change_nothing(spark, monkeypatch):
    df = spark.range(3000).selectExpr("id * 7919 % 1009 / 4 AS a", "if(id % 3 = 0, 5.0, id) AS b", "cast(null AS double) AS c", "1.0 AS d")
    want = sorted(map(tuple, numeric.numeric_describe(df, df.columns).collect()))
    some = df.agg(*[F.percentile(c, [0.25, 0.5, 0.75]) for c in "abd"], *[F.mode(c, True) for c in "abd"]).first()
    for k, row in enumerate(want):
        named = dict(zip(numeric.STATS, row, strict=True))
        assert [named["q1"], named["median"], named["q3"]] == some[k] and named["mode"] == some[3 + k]
    monkeypatch.setattr(numeric, "RANGE_ROWS", 100)
    assert sorted(map(tuple, numeric.numeric_describe(df, df.columns).collect())) == want
    assert [r[0] for r in want] == ["a", "b", "d"]
    rough = {r["column"]: r["median"] for r in numeric.numeric_describe(df, ["a"], accuracy=10_000).collect()}
    assert abs(rough["a"] - want[0][numeric.STATS.index("median")]) < 1


def test_exact_quantiles_agree_with_percentile(spark):
    df = one_column(spark, [float(x * x % 97) for x in range(500)], "double")
    got = {r["share"]: r["value"] for r in numeric.exact_quantiles(df, "v", [0.1, 0.25, 0.5, 0.99]).collect()}
    want = df.agg(F.percentile("v", [0.1, 0.25, 0.5, 0.99])).first()[0]
    assert [got[s] for s in (0.1, 0.25, 0.5, 0.99)] == pytest.approx(want)


def test_quality_of_planted_rows(spark):
    rows = [(0, "WEB", "1"), (1, "web", "2"), (2, "web", "2"), (3, None, "x"), (4, "Fulfilled", ""), (5, "Fulfiled", "3"), (6, "web", "2")]
    df = spark.createDataFrame(rows, "row_id long, c string, n string")
    missing = {r["column"]: (r["count"], r["severity"]) for r in quality.missing_values(df, ["c", "n"]).collect()}
    assert missing == {"c": (1, "warning"), "n": (1, "warning")}
    dup = quality.duplicate_rows(df, ["c", "n"]).first()
    assert (dup["count"], dup["groups"]) == (2, 1)
    assert [r["row_id"] for r in quality.duplicate_samples(df, ["c", "n"]).collect()] == [2, 6]
    clusters = {r["value"]: r["cluster"] for r in quality.category_clusters(quality.category_values(df, ["c", "n"])).collect()}
    assert clusters == {"WEB": "WEB", "web": "WEB", "Fulfilled": "Fulfiled", "Fulfiled": "Fulfiled"}
    assert [(r["column"], r["count"], r["dominant"]) for r in quality.mixed_types(df, ["c", "n"]).collect()] == [("n", 1, "number")]


def test_nulls_are_equal_but_not_across_columns(spark):
    df = spark.createDataFrame([(0, None, "a"), (1, "a", None), (2, None, "a")], "row_id long, x string, y string")
    assert quality.duplicate_rows(df, ["x", "y"]).first()["count"] == 1


def test_empty_and_blank_frames(spark):
    empty, blank = one_column(spark, []), one_column(spark, [None, " ", " "])
    assert quality.duplicate_rows(empty, ["v"]).first()["percentage"] == 0.0
    assert quality.quality_report(empty, ["v"]).filter("count > 0").count() == 0
    assert structure.infer_types(blank, ["v"]).first()["data_type"] == "null"
    assert structure.dictionary_tags(structure.structural_profile(blank, ["v"])).first()["tags"] == ["type:null", "quality:all-null", "quality:no-sample-values"]
    notices = dashboard.dashboard_notices(quality.quality_report(empty, ["v"]), numeric.outlier_counts(empty.withColumn("v", F.lit(1.0)), ["v"]), 0)
    assert [r["id"] for r in notices.collect()] == ["no-rows"]


def test_types_from_sample_or_all(spark):
    df = one_column(spark, ["1"] * 7 + ["2.5"] * 2 + ["x"])
    assert structure.infer_types(df, ["v"]).first()["data_type"] == "integer"
    assert structure.infer_types(df, ["v"], sample=None).first()["data_type"] == "integer"
    assert structure.infer_types(one_column(spark, ["1"] * 5 + ["2.5"] * 3 + ["x"]), ["v"]).first()["data_type"] == "float"


def test_chosen_columns(spark):
    assert dashboard.choose_measure_column(["age", "order_id", "height"]) == "height"
    assert dashboard.choose_measure_column(["age"]) is None
    assert dashboard.choose_measure_column(["qty", "Total_Amount"]) == "Total_Amount"
    assert dashboard.choose_date_column(["birth_date", "created_at"]) == "created_at"
    ranked = spark.createDataFrame([("x", 1), ("region", 2), ("kind", 3)], "column string, rank int")
    assert dashboard.choose_secondary_column(ranked, "kind") == "region"


def test_breakdown_folds_and_keeps_ties_as_seen(spark):
    df = one_column(spark, ["b", "a", "c", "d", "e", "f", "g", "b", " "])
    got = [(r["name"], r["value"]) for r in dashboard.category_breakdown(df, "v").orderBy("place").collect()]
    assert got == [("b", 2), ("a", 1), ("c", 1), ("d", 1), ("e", 1), ("Other", 3)]


def test_plan_is_validated():
    bad = [
        {"columns": [{"columnName": "a"}]},
        {"columns": [{"columnName": "a", "typeCoercion": {"targetType": "date", "reason": ""}}]},
        {"columns": [{"columnName": "a", "missingValuePolicy": {"action": "guess", "reason": "r"}}]},
        {"columns": [{"columnName": "", "typeCoercion": {"targetType": "date", "reason": "r"}}]},
        {"columns": [{"columnName": "a", "typeCoercion": {"targetType": "date", "reason": "r"}}] * 501},
    ]
    for plan in bad:
        with pytest.raises(cleaning.PlanError):
            cleaning.load_plan(json.dumps(plan))


def test_plan_chains_and_drops(spark):
    df = spark.createDataFrame([(0, "a", "1.9", "x"), (1, "b", "no", None), (2, "", "-2.5", "y")], "row_id long, c string, n string, k string")
    plan = cleaning.load_plan(
        {
            "columns": [
                {"columnName": "c", "valueMappings": [{"from": "a", "to": "b", "reason": "r"}, {"from": "b", "to": "c", "reason": "r"}], "missingValuePolicy": {"action": "fill-default", "defaultValue": 7, "reason": "r"}},
                {"columnName": "n", "typeCoercion": {"targetType": "integer", "reason": "r"}},
                {"columnName": "k", "missingValuePolicy": {"action": "drop-row", "reason": "r"}},
                {"columnName": "gone", "typeCoercion": {"targetType": "date", "reason": "r"}},
            ]
        }
    )
    cleaned, audit = cleaning.apply_cleaning_plan(df, plan)
    assert [tuple(r) for r in cleaned.orderBy("row_id").collect()] == [(0, "c", "1", "x"), (2, "7", "-2", "y")]
    assert [(r["column"], r["affected_rows"], r["failed_rows"], r["applied"]) for r in audit.orderBy("seq").collect()] == [
        ("c", 1, 0, True), ("c", 2, 0, True), ("n", 2, 1, True), ("gone", 0, 0, False), ("c", 1, 0, True), ("k", 1, 0, True),
    ]
    assert cleaning.composed([("a", "b"), ("b", "c"), ("a", "z"), ("c", "c")]) == {"a": ("c", (0, 1, 3)), "b": ("c", (1, 3)), "c": ("c", (3,))}
    assert {r["column"] for r in cleaning.changed_columns(audit).collect()} == {"c", "n"}


def test_reports_and_tags(spark):
    df = spark.createDataFrame([(0, "a", 1.0), (1, "b", 2.0)], "row_id long, c string, n double")
    profile = structure.structural_profile(df, ["c", "n"])
    detail = report.column_detail(profile, numeric.numeric_describe(df, ["n"]), calendar.date_profile(df, ["c"], "2024-01-01"), quality.quality_report(df, ["c", "n"]))
    text = report.assessment_report("Orders", 2, detail, quality.quality_report(df, ["c", "n"]))
    assert "| n | integer | mean 1.5 min 1.0 max 2.0 |" in text
    assert json.loads(report.analysis_summary(detail, quality.quality_highlights(quality.quality_report(df, ["c", "n"])), 2))["n_rows"] == 2
    items = structure.dictionary_tags(profile)
    assert structure.tag_filter(items, ["type:integer"]).count() == 1
    assert structure.tag_filter(items, []).count() == 2
    assert structure.tag_union(items.withColumn("m", F.array(F.lit("x"), F.lit("x"))), "m").first()["tags"][-1] == "x"
    entries = spark.createDataFrame([(0, "n", "by name"), (0, "zz", "by place")], "place int, name string, description string")
    assert {(r["description"], r["column"]) for r in report.dictionary_attach(entries, profile).collect()} == {("by name", "n"), ("by place", "c")}
    assert structure.industry_hints(df.withColumnRenamed("c", "patient_name")).first()["industry"] == "healthcare"


def test_dates_with_month_names(spark):
    want = {
        "January 5, 2024": "2024-01-05", "Jan 5, 2024": "2024-01-05", "5 January 2024": "2024-01-05", "5 Jan 2024": "2024-01-05", "Sept 5, 2024": "2024-09-05",
        "Jan 5 2024": "2024-01-05", "5-Jan-2024": "2024-01-05", "jun. 30, 1999": "1999-06-30", "Fri, Jan 5, 2024 10:30": "2024-01-05", "MAY 1, 2020": "2020-05-01",
        "Feb 30, 2024": "2024-03-01", "ORD-50276": None, "SKU-2024": None, "Mayor 5, 2024": None, "Jan 45, 2024": None, "5 marching 2024": None, "market 5 2024": None,
        "2024-02-30": None, "2024-02-29T10:00:00Z": "2024-02-29", "0000-01-01": None, "25/12/2024": "2024-12-25", "1.2.3": "2003-01-02", "1/1/69": "1969-01-01", "2024/3/4": "2024-03-04",
        "": None, "  2024-01-31\u00a0": "2024-01-31", "31/04/2024": None, "13/13/2024": None, "99999-01-01": None,
    }
    df = spark.createDataFrame([(i, v) for i, v in enumerate(want)], "row_id long, d string")
    got = {r["original"]: r["normalized"] for r in calendar.date_values(df, "d", "2024-12-31").collect()}
    assert got == want
    numbers = spark.createDataFrame([(1, 20240131, 1.5, True)], "row_id long, a long, b double, c boolean")
    assert [r["n_parsed"] for r in calendar.detect_date_columns(numbers, ["a", "b", "c"]).collect()] == [0, 0, 0]


@pytest.mark.parametrize("n", [1, 50, 3000])
def test_long_plans_against_loops(spark, n):
    entries = [{"from": f"v{k}", "to": f"v{k + 1}" if k < 5 else "end", "reason": f"r{k}"} for k in range(n)]
    cells = ["v0", "v1", "v1", "v7", "w", None, f"v{n - 1}", "end", "é"]
    df = spark.createDataFrame(list(enumerate(cells)), "row_id long, c string")
    cleaned, audit = cleaning.apply_cleaning_plan(df, cleaning.load_plan({"columns": [{"columnName": "c", "valueMappings": entries}]}))
    hits, now = [0] * n, list(cells)
    for k, e in enumerate(entries):
        hits[k] = now.count(e["from"])
        now = [e["to"] if x == e["from"] else x for x in now]
    assert [r["c"] for r in cleaned.orderBy("row_id").collect()] == now
    assert [(r["affected_rows"], r["applied"], r["detail"]) for r in audit.orderBy("seq").collect()] == [(h, h > 0, f"{e['from']} -> {e['to']}") for h, e in zip(hits, entries, strict=True)]


def test_plans_run_nothing_while_they_are_made(spark):
    """500 columns of 60 mappings: no job for the plan, one stage of tasks over the source for the audit."""
    names = [f"a.{k}`" for k in range(500)]
    df = spark.createDataFrame([tuple(f"m{(i + k) % 90}" for k in range(500)) for i in range(30)], ", ".join("`" + n.replace("`", "``") + "` string" for n in names))
    plan = cleaning.load_plan({"columns": [{"columnName": c, "valueMappings": [{"from": f"m{k}", "to": "x", "reason": "r"} for k in range(60)]} for c in names]})
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planned", "planned")
    cleaned, audit = cleaning.apply_cleaning_plan(df, plan)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not tracker.getJobIdsForGroup("planned")
    assert cleaned.columns == names
    got = audit.filter("affected_rows > 0").agg(F.sum("affected_rows"), F.count("*")).first()
    assert got[0] == sum((i + k) % 90 < 60 for i in range(30) for k in range(500)) and got[1] <= 30_000


def test_typed_plans_and_written_ones(spark, tmp_path):
    rows = [(0, "1.9", "Jan 5, 2024", "yes", None), (1, "no", "2024-02-30", "maybe", "k"), (2, "", None, "", "k"), (3, "-2", "31/12/2023", "FALSE", "k")]
    df = spark.createDataFrame(rows, "row_id long, `n.o` string, d string, b string, k string")
    plan = cleaning.load_plan({"columns": [
        {"columnName": "n.o", "typeCoercion": {"targetType": "integer", "reason": "r"}, "missingValuePolicy": {"action": "fill-default", "defaultValue": 7, "reason": "r"}},
        {"columnName": "d", "typeCoercion": {"targetType": "date", "reason": "r"}}, {"columnName": "b", "typeCoercion": {"targetType": "boolean", "reason": "r"}},
        {"columnName": "k", "missingValuePolicy": {"action": "drop-row", "reason": "r"}},
    ]})
    for typed in (False, True):
        lazy, audit = cleaning.apply_cleaning_plan(df, plan, typed)
        written, again = cleaning.write_cleaned(df, plan, f"file://{tmp_path}/{typed}", typed)
        assert sorted(map(tuple, lazy.collect())) == sorted(map(tuple, written.collect())) and lazy.columns == written.columns
        assert [tuple(r) for r in audit.orderBy("seq").collect()] == [tuple(r) for r in again.orderBy("seq").collect()]
    assert dict(lazy.dtypes) == {"row_id": "bigint", "n.o": "bigint", "d": "date", "b": "boolean", "k": "string", "n.o_uncoerced": "string", "d_uncoerced": "string", "b_uncoerced": "string"}
    got = [(r["row_id"], r["n.o"], str(r["d"]), r["b"], r["n.o_uncoerced"], r["d_uncoerced"], r["b_uncoerced"]) for r in lazy.orderBy("row_id").collect()]
    assert got == [(1, None, "None", None, "no", "2024-02-30", "maybe"), (2, 7, "None", None, None, None, None), (3, -2, "2023-12-31", False, None, None, None)]
    assert [(r["column"], r["affected_rows"], r["failed_rows"]) for r in audit.orderBy("seq").collect()] == [("n.o", 2, 1), ("d", 2, 1), ("b", 2, 1), ("n.o", 1, 0), ("k", 1, 0)]


def test_names_of_any_kind(spark):
    """Every operator over columns whose names hold dots, blanks, backticks and quotes, beside the same under plain names."""
    odd = ["row id.", "Unit.Price", "a b`c", "seg'ment", 'd"ate', "num ber.1"]
    plain = ["r", "p", "c", "s", "d", "n"]
    rows = [(i, f"{i % 7}.5" if i % 5 else "x", "Web web WEB store".split()[i % 4], f"S{i % 3}" if i % 8 else "", f"2024-0{1 + i % 9}-11", float(i * i)) for i in range(40)]
    rows += rows[:3]
    results = []
    for names in (odd, plain):
        df = spark.createDataFrame(rows, "r long, p string, c string, s string, d string, n double").toDF(*names)
        r, p, c, s, d, n = names
        back = dict(zip(names, plain, strict=True))
        described = numeric.numeric_describe(df, [p, n])
        report_ = quality.quality_report(df, names, r)
        profile = structure.structural_profile(df, names, r)
        plan = cleaning.load_plan({"columns": [{"columnName": c, "valueMappings": [{"from": "WEB", "to": "web", "reason": "r"}], "missingValuePolicy": {"action": "drop-row", "reason": "r"}}, {"columnName": p, "typeCoercion": {"targetType": "float", "reason": "r"}}]})
        cleaned, audit = cleaning.apply_cleaning_plan(df, plan)
        made = [
            profile, structure.infer_types(df, names, r, None), structure.sample_values(df, names, r), structure.table_stats(df), structure.dictionary_tags(profile),
            quality.missing_values(df, names), quality.duplicate_rows(df, names), quality.duplicate_samples(df, names, r), quality.mixed_types(df, names, r), quality.mixed_type_examples(df, names, r),
            quality.category_values(df, names), quality.inconsistent_categoricals(df, names), report_, quality.finding_samples(df, names, r), quality.finding_details(report_, names),
            described, numeric.outlier_rows(df, [p, n], r), numeric.outlier_counts(df, [p, n], r), numeric.numeric_distribution(df, n), numeric.exact_quantiles(df, n, [0.5]),
            calendar.detect_date_columns(df, names), calendar.date_values(df, d, "2024-12-31", r), calendar.date_profile(df, [d], "2024-12-31"), calendar.trend_monthly(df, d), calendar.flagged_dates(df, d, "2024-05-01", r),
            dashboard.distinct_categories(df, names), dashboard.filter_by_category(df, c, "Web"), dashboard.kpi_measure(df, n), dashboard.kpi_top_category(df, c, r), dashboard.segment_kpis(df, s, n),
            dashboard.category_breakdown(df, c, r), dashboard.category_measure_breakdown(df, c, n, r), dashboard.choose_charts(df, d, [c], n, r), dashboard.segment_notices(df, names, [p, n], s, r),
            dashboard.rank_filter_columns(dashboard.distinct_categories(df, names), quality.inconsistent_categoricals(df, names)),
            cleaned, audit, cleaning.cleaning_summary(audit), cleaning.raw_vs_cleaned(df, cleaned, audit), cleaning.preview(df, r, 3), report.eda(df, profile, "2024-12-31", r),
        ]
        results.append([(named(m.columns, back), sorted(repr(named(list(row), back)) for row in m.collect())) for m in made])
    for k, (a, b) in enumerate(zip(*results, strict=True)):
        assert a == b, k


def named(x, back):
    """x with the names of columns replaced, wherever they stand."""
    if isinstance(x, str):
        for name, short in back.items():
            x = x.replace(name, short)
    return [named(v, back) for v in x] if isinstance(x, list) else x


def test_segments_as_if_each_were_alone(spark):
    rows = [(i, f"S{i % 3}" if i % 7 else " ", ["web", "Web", "store", "phone"][i % (2 + i % 3)], str(i % 4) if i % 6 else "x", float(i % 5) if i % 31 else 1000.0 + i) for i in range(400)]
    rows += [(500 + i, *r[1:]) for i, r in enumerate(rows[:50])]
    df = spark.createDataFrame(rows, "row_id long, s string, c string, m string, n double")
    columns = ["s", "c", "m", "n"]
    by = dashboard._category(df, "s")
    report_, notices = quality.quality_report_by(df, columns, by).collect(), dashboard.segment_notices(df, columns, ["m", "n"], "s").collect()
    outliers = numeric.outlier_counts_by(df, ["m", "n"], by, ["S0", "S1", "S2"]).collect()
    for value in (None, "S0", "S1", "S2"):
        view = dashboard.filter_by_category(df, "s", value)
        alone = quality.quality_report(view, columns)
        of = lambda found, key="g": sorted(tuple(r)[1:] for r in found if r[key] == value)  # noqa: B023, E731
        assert of(report_) == sorted(map(tuple, alone.collect()))
        counts = numeric.outlier_counts(view, ["m", "n"])
        assert of(outliers) == sorted(map(tuple, counts.collect()))
        assert of(notices, "segment") == sorted(map(tuple, dashboard.dashboard_notices(alone, counts, view.count()).collect()))
    with pytest.raises(ValueError):
        dashboard.segment_notices(spark.range(40).selectExpr("id AS row_id", "cast(id AS string) AS s", "1.0 AS n"), ["s", "n"], ["n"], "s")
