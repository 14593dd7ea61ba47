"""Every registered query of the engine against DuckDB over the smallest tables."""

import glob
import itertools
import os

import duckdb
import pytest

from orrery.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_duckdb(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    want = [tuple(r[names.index(c)] for c in df.columns) for r in cursor.fetchall()]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))


def test_delete_of_zeros_and_unknown_segments_as_duckdb(spark, tmp_path):
    balances, segments = (-0.0, 0.0, -0.01, 0.01, float("nan"), float("-inf")), ("BUILDING", "MACHINERY", None)
    rows = [(i, f"c{i}", i % 3, *r) for i, r in enumerate(itertools.product(balances, segments))]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    want = duckdb.execute(ORACLES["dml_delete"].replace("FROM customer", f"FROM '{tmp_path}/customer.parquet/*.parquet'")).fetchall()
    got = QUERIES["dml_delete"](spark, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and {r[0] for r in want} == {1, 4, 10, 13}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["o_orderkey", "c_name", "o_totalprice"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_works_without_the_optional_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("orrery", "tests"):
        shutil.copytree(f"{root}/{name}", tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = """
import __spark_entry__ as e
assert e.queries() and not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in e.queries())
assert set(e.oracle_sql()) == set(e.queries())
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    listed = subprocess.run([sys.executable, "-m", "pytest", "tests", "--collect-only", "-q"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert listed.returncode == 0, listed.stdout
