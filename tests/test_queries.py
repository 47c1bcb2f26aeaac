"""Every registered query against its SQL in DuckDB, over the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from clickloom import workload


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def same(spark, sf, db, query, sql):
    df = query(spark, sf)
    want = db.sql(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    a = sorted(repr(tuple(r[n] for n in order)) for r in df.collect())
    b = sorted(repr(tuple(r[names.index(n)] for n in order)) for r in want.fetchall())
    assert a == b


@pytest.mark.parametrize("name", list(workload.queries()))
def test_query(spark, sf, db, name):
    same(spark, sf, db, workload.queries()[name], workload.oracle_sql()[name])


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["url", "granularity", "bucket", "total_pageviews"]


def test_without_the_training_data_part(tmp_path):
    """The entry point imports, and has its other queries, where that part was taken away."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/clickloom", tmp_path / "clickloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert set(e.queries()) == set(e.oracle_sql()) and len(e.queries()) > 30"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": ""})


def test_without_a_library_of_that_part():
    """A library that only that part needs may be missing: the other queries stay."""
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; assert set(e.queries()) == set(e.oracle_sql()) and len(e.queries()) > 30"
    subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=root, check=True)
