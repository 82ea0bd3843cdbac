import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from weft import queries as core

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(rows):
    value = lambda v: round(v, 4) + 0.0 if isinstance(v, float) else str(v)
    return sorted([tuple(map(value, r)) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_query_equals_its_sql(spark, oracle, name):
    got = core.QUERIES[name](spark, SF)
    want = oracle.sql(core.ORACLES[name])
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    at = [want.columns.index(c) for c in names]
    assert plain([[r[c] for c in names] for r in got.collect()]) == plain([[r[k] for k in at] for r in want.fetchall()])


def test_entry(spark):
    assert entry.entry(spark).count() == 17871
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("gone", [["weft/llm", "tests/llm"], ["weft/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_entry_without_the_corpus_operators(tmp_path, gone):
    """The queries that remain register, and this file's test of the entry passes, in a copy without these."""
    root = Path(entry.__file__).resolve().parent
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in gone:
        shutil.rmtree(copy / name) if (copy / name).is_dir() else (copy / name).unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and 'q01' in q; print(sum(n.startswith('op') for n in q), 'pipeline' in q)"
    env = os.environ | {"PYTHONPATH": ""}
    made = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True, check=True).stdout.split()
    assert made[1] == "False" and (made[0] == "0") == ("weft/llm" in gone or not (root / "weft/llm").is_dir())
    tested = subprocess.run([sys.executable, "-m", "pytest", "-q", "tests/test_entry.py::test_entry"], cwd=copy, env=env, capture_output=True, text=True)
    assert tested.returncode == 0, tested.stdout
