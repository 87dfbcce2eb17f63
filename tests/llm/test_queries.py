"""The registered queries over the smallest tables, those with SQL against it."""

import os

import duckdb
import numpy as np
import pytest

from logloom.llm import queries

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(SF_DIR):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{name}'")
    return con


def values(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr([round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    df = queries.queries()[name](spark, SF_DIR)
    found = db.execute(queries.oracle_sql()[name])
    assert values(df.columns, [tuple(r) for r in df.collect()]) == values([c[0] for c in found.description], found.fetchall())


def test_quality_rules_agree_with_labels(spark, db):
    got = {r["doc_id"]: r for r in queries.op1_quality_rules(spark, SF_DIR).collect()}
    assert len(got) == db.execute("SELECT count(*) FROM documents").fetchone()[0]
    assert all(r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) and not (r["kept"] and r["base_failed"]) for r in got.values())
    labels = db.execute("SELECT doc_id, quality FROM labels").fetchall()
    judged = [(got[i]["kept"], q == 1) for i, q in labels if not got[i]["base_failed"]]
    assert sum(k == q for k, q in judged) >= 0.95 * len(judged)


def test_neighbours_equal_brute_force(spark, db):
    x = np.array(db.execute("SELECT embedding FROM embeddings ORDER BY vec_id").fetchnumpy()["embedding"].tolist(), float)
    ids = [r[0] for r in db.execute("SELECT vec_id FROM embeddings ORDER BY vec_id").fetchall()]
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in queries.op4_nearest_neighbours(spark, SF_DIR).collect()}
    for q in [i for i in ids if i % 20 == 0]:
        scores = x @ x[ids.index(q)]
        best = sorted((i for i in ids if i != q), key=lambda i: (-scores[ids.index(i)], i))[:20]
        assert [got[q, k + 1][1] for k in range(len(best))] == pytest.approx([scores[ids.index(i)] for i in best])


@pytest.mark.parametrize("name", ["op6_quality_classifier", "op8_toxicity"])
def test_scores_agree_with_held_out_labels(spark, db, name):
    rows = {r["doc_id"]: r for r in queries.queries()[name](spark, SF_DIR).collect()}
    assert len(rows) == db.execute("SELECT count(*) FROM documents").fetchone()[0] and all(0 <= r["score"] <= 1 for r in rows.values())
    column = "quality" if name.startswith("op6") else "toxic"
    held = [(rows[i]["predicted"], y) for i, y in db.execute(f"SELECT doc_id, {column} FROM labels").fetchall() if rows[i]["held_out"]]
    assert held and sum(p == y for p, y in held) >= 0.8 * len(held)  # some sixty rows to learn from
