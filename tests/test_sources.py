from datetime import datetime, timezone

import pytest

from tableprobe.sources import sinks, tables


def test_headers():
    assert tables.unique_headers(["a", "a", "", " b "]) == ["a", "a_2", "column_3", "b"]


def test_encoding():
    assert tables.detect_encoding("é".encode()) == "utf-8"
    assert tables.detect_encoding(b"caf\xe9") == "windows-1252"
    assert tables.detect_encoding(b"a" * (64 * 1024 - 1) + "é".encode()) == "utf-8"


def test_delimited(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_bytes('﻿id,name,name\r\n1,"a, ""b""",x\r\n2,short\r\n , ,\r\n3,c,d,extra\r\n'.encode())
    df = tables.read_delimited(spark, f"file://{path}")
    assert df.columns == ["id", "name", "name_2"]
    assert sorted(tuple(r) for r in df.collect()) == [("1", 'a, "b"', "x"), ("2", "short", ""), ("3", "c", "d")]
    latin = tmp_path / "y.txt"
    latin.write_bytes(b"a;b\ncaf\xe9 \x80;1\n")
    assert [tuple(r) for r in tables.read_delimited(spark, f"file://{latin}").collect()] == [("café €", "1")]
    (tmp_path / "e.csv").write_bytes(b"")
    with pytest.raises(tables.SourceError) as e:
        tables.read_delimited(spark, f"file://{tmp_path}/e.csv")
    assert e.value.cause == "empty-file"


def test_quoted_line_ends(spark, tmp_path):
    (tmp_path / "m.csv").write_text('a,b\n"x\ny",1\n')
    assert tables.read_delimited(spark, f"file://{tmp_path}/m.csv", multi_line=True).first()["a"] == "x\ny"


DUMP = r"""-- a dump
CREATE TABLE `orders` (
  `id` int NOT NULL, `name` varchar(20), amount DECIMAL(10,2), PRIMARY KEY (`id`), KEY k (`name`)
) ENGINE=InnoDB;
INSERT INTO `orders` VALUES (1,'it''s (a), test',2.50),(2,NULL,-3);
/* more */
INSERT INTO orders (amount, id) VALUES (9, 3);
CREATE TABLE other (x int);
INSERT INTO other VALUES (1);
INSERT INTO orders VALUES (4,'back\\slash\n');
"""


def test_sql_dump(spark, tmp_path):
    (tmp_path / "d.sql").write_text(DUMP)
    df = tables.read_sql_dump(spark, f"file://{tmp_path}/d.sql")
    assert df.columns == ["id", "name", "amount"]
    assert sorted(map(tuple, df.collect())) == [("1", "it's (a), test", "2.50"), ("2", None, "-3"), ("3", None, "9"), ("4", "back\\slash\n", None)]
    assert tables.read_sql_dump(spark, f"file://{tmp_path}/d.sql", row_limit=2).count() == 2


def test_csv_out(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a,"b"', None), (2, "plain", "")], "id int, t string, u string")
    sinks.write_csv(df, f"file://{tmp_path}/out", single_file=True)
    data = next((tmp_path / "out").glob("part-*")).read_bytes()
    assert data == b'id,t,u\r\n1,"a,""b""",\r\n2,plain,\r\n'


def test_runs(spark, tmp_path):
    path = f"file://{tmp_path}/runs"
    assert sinks.list_runs(spark, path).count() == 0
    for k, name in enumerate(("a", "b")):
        sinks.write_run(spark, path, name, f"{name}.csv", k, "{}", datetime(2024, 1, 1 + k, tzinfo=timezone.utc))
    assert [r["dataset_id"] for r in sinks.list_runs(spark, path).collect()] == ["b", "a"]
    sinks.update_run(spark, path, "a", status="error")
    assert (sinks.get_run(spark, path, "a").first()["status"], sinks.list_runs(spark, path).count()) == ("error", 2)
    with pytest.raises(KeyError):
        sinks.update_run(spark, path, "zz", status="x")
    sinks.delete_run(spark, path, "b")
    sinks.delete_run(spark, path, "zz")
    assert [r["dataset_id"] for r in sinks.list_runs(spark, path).collect()] == ["a"]


def test_validation(spark):
    df = spark.createDataFrame([], "a string")
    assert tables.validate_source(df, need_rows=False) is df
    with pytest.raises(tables.SourceError):
        tables.validate_source(df)


def test_sql_dump_with_crlf_and_what_follows_tuples(spark, tmp_path):
    text = r"""CREATE TABLE o (`a` int, b varchar(9) DEFAULT 'x,(y', c enum('p,q','r')); -- the end
INSERT IGNORE INTO `O` VALUES (1,'x;y',NOW()),(2,"it""s",CONCAT('a,b','c')) ON DUPLICATE KEY UPDATE a=VALUES(a); INSERT INTO o (a) VALUES (3);
INSERT INTO o SELECT * FROM o;
INSERT INTO other VALUES (9,9,9);
INSERT INTO o VALUES ();
"""
    want = [("1", "x;y", "NOW()"), ("2", 'it"s', "CONCAT('a,b','c')"), ("3", None, None), (None, None, None)]
    for name, end in (("lf", "\n"), ("crlf", "\r\n")):
        (tmp_path / f"{name}.sql").write_bytes(text.replace("\n", end).encode())
        df = tables.read_sql_dump(spark, f"file://{tmp_path}/{name}.sql", row_id="n").orderBy("n")
        assert [tuple(r)[1:] for r in df.collect()] == want
    with pytest.raises(tables.SourceError):
        list(tables.insert_rows("INSERT INTO o VALUES (1, 'open", "o", ["a"]))


def test_row_numbers_follow_files_and_blocks(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"p{k}.csv").write_text("a,b\n" + "".join(f"{k * 1000 + i},{'x' * (k + 1)}\n" for i in range(300)) + (" , \n" if k == 1 else ""))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        df = tables.read_delimited(spark, f"file://{tmp_path}", delimiter=",", row_id="row_id")
        assert df.rdd.getNumPartitions() > 3
        rows = df.orderBy("row_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert df.columns == ["row_id", "a", "b"]
    assert [int(r["a"]) for r in rows] == [k * 1000 + i for k in range(3) for i in range(300)]
    assert [r["row_id"] for r in rows] == [*range(600), *range(601, 901)]  # the blank row had number 600
    spark.createDataFrame([(5,), (6,)], "v int").coalesce(1).write.parquet(f"file://{tmp_path}/t")
    assert sorted(map(tuple, tables.read_table(spark, f"file://{tmp_path}/t", row_id="n").collect())) == [(0, 5), (1, 6)]
    with pytest.raises(ValueError):
        tables.read_table(spark, f"file://{tmp_path}/t", row_id="v")
    assert tables.source_bytes(spark, f"file://{tmp_path}/p0.csv") == (tmp_path / "p0.csv").stat().st_size
