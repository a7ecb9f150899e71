"""The driver's contract, plans that must not hold a product, and every registered query against its SQL."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from loamline import queries

SMALL = "/root/testdata/sf0.001"
REPO = Path(__file__).resolve().parent.parent
needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the generated tables are not here")


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_tables
def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_is_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    got = queries.QUERIES[name](spark, SMALL)
    columns = sorted(got.columns)
    expected = con.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, expected))


@needs_tables
@pytest.mark.parametrize("name", ["keyword_match", "vector_topk", "walk_upstream", "drop_unchanged"])
def test_no_products(spark, name):
    plan = queries.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


@needs_tables
def test_top_k_is_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in queries.vector_topk(spark, SMALL)._jdf.queryExecution().executedPlan().toString()


def test_the_rest_stands_alone(tmp_path):
    """Without the subpackage, its tests and the pipeline the registry has the library's queries, and the other tests run."""
    gone = shutil.ignore_patterns("llm", "__pycache__")
    for name in ("loamline", "tests"):
        shutil.copytree(REPO / name, tmp_path / name, ignore=gone)
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    env = os.environ | {"PYTHONPATH": str(tmp_path)}
    code = "import __spark_entry__ as e; assert not any(n.startswith('op') for n in e.queries()); print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=env)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) == len(queries.QUERIES)
    rest = subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", "tests/test_lineage.py", "tests/test_stemming.py", "-k", "imports or stems"], cwd=tmp_path, capture_output=True, text=True, env=env)
    assert rest.returncode == 0, rest.stdout
