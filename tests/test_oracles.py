"""Every library query against its DuckDB SQL over the smallest tables; the optional subpackage's guard."""

import os
import subprocess
import sys

import duckdb
import pytest

from logloom.plans import catalog

SF_DIR = "/root/testdata/sf0.001"
REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

needs_data = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(SF_DIR):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{name}'")
    return con


def values(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr([round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order]) for r in rows)


@needs_data
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    df = catalog.queries()[name](spark, SF_DIR)
    found = db.execute(catalog.oracle_sql()[name])
    assert values(df.columns, [tuple(r) for r in df.collect()]) == values([c[0] for c in found.description], found.fetchall())


@needs_data
@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_gives_rows(spark, name):
    assert not catalog.queries()[name](spark, SF_DIR).isEmpty()


def test_entry_works_without_the_subpackage(tmp_path):
    for name in ("logloom", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", f"{REPO}/{name}", str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", f"{tmp_path}/logloom/llm"], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'record_layer_stats' in q and not [n for n in q if n.startswith('op')] and 'pipeline' not in q; print(len(q), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
