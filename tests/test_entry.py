import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tableprobe.plans.oracle import ORACLE
from tableprobe.plans.queries import QUERIES


def test_every_own_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_registry_holds_them():
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_expected_facts_of_the_dirty_view(spark):
    from tableprobe.plans.dirty import COLUMNS, dirty_orders
    from tableprobe.operators import quality

    d = dirty_orders(spark, "/root/testdata/sf0.001")
    assert d.count() == 1503
    assert quality.duplicate_rows(d, COLUMNS).first()["count"] == 3


@pytest.mark.parametrize("gone", [["tableprobe/llm"], ["tableprobe/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"], []])
def test_registry_without_the_training_operators(tmp_path, gone):
    root = Path(entry.__file__).parent
    shutil.copytree(root / "tableprobe", tmp_path / "tableprobe", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (root / name).exists():
            shutil.copy(root / name, tmp_path)
    for name in gone:
        if (tmp_path / name).is_dir():
            shutil.rmtree(tmp_path / name)
        elif (tmp_path / name).exists():
            (tmp_path / name).unlink()
    places = [x for x in os.environ.get("PYTHONPATH", "").split(os.pathsep) if x and Path(x).resolve() != root.resolve()]
    env = os.environ | {"PYTHONPATH": os.pathsep.join(places)}
    told = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.oracle_sql(); print(*e.queries())"], cwd=tmp_path, env=env, capture_output=True, text=True, check=True)
    names = told.stdout.split()
    assert set(QUERIES) <= set(names)
    here = all((root / name).exists() for name in ("tableprobe/llm", "corpus_pipeline.py"))
    assert ("pipeline" in names) == (not gone and here)
    if "tableprobe/llm" in gone or not (root / "tableprobe/llm").exists():
        assert set(names) == set(QUERIES)
