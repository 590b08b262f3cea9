"""Folders of unlike files, and records that cross lines and blocks, against readers of whole files."""

import csv
import io
import random

import pytest

from tableprobe.sources import records, tables


@pytest.fixture
def small_blocks(spark):
    """Blocks of a few hundred bytes, so that a file is read by many tasks."""
    conf = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_headers_and_encodings_of_each_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b.c\n1,2\né,4\n")
    (tmp_path / "b.txt").write_text("b.c;a;new col`\n3;4;5\n")
    (tmp_path / "c.csv").write_bytes("b.c,a\ncaf\xe9 \x80,".encode("latin-1") + b"\x80\n")
    (tmp_path / "_skipped").write_text("x\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "d.tsv").write_text("﻿a\tb.c\n,\ttab\n , \t \n")
    df = tables.read_delimited(spark, f"file://{tmp_path}", row_id="n.o")
    assert df.columns == ["n.o", "a", "b.c", "new col`"]
    got = [tuple(r) for r in df.orderBy("`n.o`").collect()]
    assert [r[1:] for r in got] == [("1", "2", ""), ("é", "4", ""), ("4", "3", "5"), ("€", "café €", ""), (",", "tab", "")] + [(" , ", " ", "")]
    assert [r[0] for r in got] == list(range(6))


def test_delimiters_by_extension_meet_by_name(spark, tmp_path):
    (tmp_path / "one").mkdir()
    (tmp_path / "one/a.csv").write_text("a,b\n1,2\n")
    (tmp_path / "one/b.csv").write_text("b,a\n3,4\n")
    assert sorted(map(tuple, tables.read_delimited(spark, f"file://{tmp_path}/one").collect())) == [("1", "2"), ("4", "3")]
    assert sorted(map(tuple, tables.read_delimited(spark, f"file://{tmp_path}/one", multi_line=True).collect())) == [("1", "2"), ("4", "3")]


def cell(rng):
    kind = rng.random()
    if kind < 0.3:
        return "".join(rng.choice('ab,"\n\r;') for _ in range(rng.randrange(40))).replace("\r", "\r\n" if rng.random() < 0.5 else "r")
    if kind < 0.35:
        return "long\n" * rng.randrange(200)
    return rng.choice(["", "x", "5\" pipe", "it's", "é€", " lead", "trail ", "NULL"])


@pytest.mark.parametrize("seed,end", [(1, "\n"), (2, "\r\n"), (3, "\n")])
def test_quoted_line_ends_over_many_blocks(spark, tmp_path, small_blocks, seed, end):
    rng, rows = random.Random(seed), []
    for k in range(2):
        out = io.StringIO(newline="")
        w = csv.writer(out, lineterminator=end)
        w.writerow(["id", "a\nb", "c"][:: 1 if k == 0 else -1])
        own = [[f"{k}-{i}", cell(rng), cell(rng)] for i in range(60)]
        for r in own:
            w.writerow(r[:: 1 if k == 0 else -1])
            if rng.random() < 0.1:
                out.write(end)
        rows += own
        (tmp_path / f"p{k}.csv").write_bytes(out.getvalue().encode())
    read = records.lines(spark, [f"file://{tmp_path}/p0.csv"])
    states = records.placed(records.functions_of(read, records.Delimited(","))).collect()
    assert len(states) > 5 and read.rdd.getNumPartitions() > 5 and any(r["state"] for r in states)
    df = tables.read_delimited(spark, f"file://{tmp_path}", multi_line=True, row_id="row")
    assert df.columns == ["row", "id", "a\nb", "c"]
    got = [tuple(r) for r in df.orderBy("row").collect()]
    assert [r[1:] for r in got] == [tuple(r) for r in rows]
    assert [r[0] for r in got] == list(range(len(rows)))


def test_joined_states_give_the_same_records(spark, tmp_path, small_blocks):
    (tmp_path / "x.csv").write_text("a,b\n" + "".join(f'{k},"{"l" * (k % 90)}\n{k}"\n' for k in range(100)))
    lexer, read = records.Delimited(","), records.lines(spark, [f"file://{tmp_path}/x.csv"])
    states = records.placed(records.functions_of(read, lexer)).persist()
    sent, joined = ({(r["number"], bytes(r["text"])) for r in records.records(read, lexer, states, most_blocks=n).collect()} for n in (1000, 0))
    assert sent == joined and len(sent) == 101


def test_an_open_quote_takes_the_rest(spark, tmp_path, small_blocks):
    (tmp_path / "x.csv").write_text('a,b\n1,2\n3,"open\n' + "4,5\n" * 200)
    got = tables.read_delimited(spark, f"file://{tmp_path}/x.csv", multi_line=True).collect()
    assert len(got) == 2 and got[1]["b"].count("\n") == 201 - (not got[1]["b"].endswith("\n"))


def literal(rng):
    text = "".join(rng.choice(["a", ";\n", ";\r\n", "'", '"', "\\", "--", "/*", "*/", "#", "(", ")", ",", "`", "\n", "é"]) for _ in range(rng.randrange(25)))
    quote = rng.choice("'\"")
    written = text.replace("\\", "\\\\").replace(quote, rng.choice([quote * 2, "\\" + quote]))
    return text, quote + written + quote


@pytest.mark.parametrize("seed,end", [(1, "\n"), (2, "\r\n"), (3, "\n")])
def test_sql_literals_over_many_blocks(spark, tmp_path, small_blocks, seed, end):
    rng, rows, out = random.Random(seed), [], ["-- it's a dump; really", "/* ; ' */ CREATE TABLE `a.b` (", "  id int, -- ; '", "  `x;\ny` text, z.z varchar(9)", ");", ""]
    for k in range(60):
        tuples = []
        for _ in range(rng.randrange(1, 4)):
            (a, x), (b, y) = literal(rng), literal(rng)
            rows.append((str(len(rows)), a, b))
            tuples.append(f"({len(rows) - 1}, {x},{y})")
        out.append(rng.choice(["", "# a 'comment;", "/* ;\n'\n*/ "]) + ("\n" if rng.random() < 0.5 else ""))
        if out[-1].startswith("#"):
            out.append("")
        out.append(f"INSERT INTO `a.b` VALUES{rng.choice([' ', '  '])}" + ("," + rng.choice(["", "\n"])).join(tuples) + rng.choice([";", " ;", ";;", "; -- done"]))
        if k % 7 == 0:
            out.append("INSERT INTO other VALUES (';\n');")
    out.append("INSERT INTO `a.b` (id) VALUES (999)")
    text = "\n".join(out)
    if end == "\r\n":  # so do literals
        text, rows = text.replace("\r", "").replace("\n", end), [tuple(c.replace("\r", "").replace("\n", end) for c in r) for r in rows]
    (tmp_path / "d.sql").write_bytes(text.encode())
    df = tables.read_sql_dump(spark, f"file://{tmp_path}/d.sql", row_id="n")
    assert df.columns == ["n", "id", f"x;{end}y", "z.z"]
    assert df.rdd.getNumPartitions() > 5
    got = [tuple(r)[1:] for r in df.orderBy("n").collect()]
    assert got == [*rows, ("999", None, None)]
