"""Exact top-k search against all inner products."""

import math
import os

import duckdb
import numpy as np
import pytest

from tapeloom.llm import q_topk, topk

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, k=5):
    """(query_id, rank, vec_id, score) by all inner products of rows (id, vector of whole numbers)."""
    out = set()
    for q_id in {i for i, _ in rows if i % 50 == 0}:
        q = min(v for i, v in rows if i == q_id)
        near = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), i) for i, v in rows if i != q_id and len(v) == len(q))[:k]
        out |= {(q_id, r, i, -s) for r, (s, i) in enumerate(near, 1)}
    return out


def got(df):
    return {(r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect()}


def whole(rows):
    return [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]


@pytest.mark.parametrize("sizes", [{}, {"part_rows": 40, "block_queries": 2}])
def test_against_all_pairs_with_ties_and_copies(spark, sizes):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=16).astype("float32").tolist()) for i in range(1, 400)]
    rows += [(i, rows[0][1]) for i in range(400, 520)]  # a large group of copies, queries among them
    rows += [(i, rng.integers(-1, 2, 16).astype("float32").tolist()) for i in range(520, 700)]  # many ties
    assert got(topk.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), **sizes)) == plain(whole(rows))


def test_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, -2.0]), (50, [0.0, 0.0]), (100, None), (150, [nan, 1.0]), (200, [inf, 1.0]), (250, [None, 1.0]), (None, [1.0, 1.0]), (300, []), (350, []), (400, [1.0]), (7, [5.0, 5.0]), (7, [5.0, 5.0]), (8, [-3.0, 2.5]), (50, [0.0, 1.0]), (-50, [0.5, -0.25])]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, VEC_ID string")
    assert got(topk.neighbours(df)) == plain(whole(rows))


def test_empty_and_single(spark):
    assert got(topk.neighbours(spark.createDataFrame([], SCHEMA))) == set()
    assert got(topk.neighbours(spark.createDataFrame([(50, [1.0], 0)], SCHEMA))) == set()
    assert got(topk.neighbours(spark.createDataFrame([(51, [1.0], 0), (52, [1.0], 0)], SCHEMA))) == set()


def test_large_components_use_separate_sums(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-(1 << 26), 1 << 26, 6).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, vector array<long>")
    assert got(topk.search(df.where("id % 50 = 0"), df)) == plain(rows)


def test_scores_beyond_a_long_are_refused():
    with pytest.raises(OverflowError):
        topk.Lists(np.array([[1 << 50, 1 << 50]]))
    lists = topk.Lists(np.array([[1 << 40, 0]]))
    with pytest.raises(OverflowError):
        topk._fits(np.array([1 << 40, 0]), lists)


def test_reading_stops_early_when_one_list_decides():
    rng = np.random.default_rng(5)
    rows = np.concatenate([rng.permutation(20_000)[:, None], rng.integers(-2, 3, (20_000, 3))], axis=1)
    found, scores = topk.Lists(rows).best(np.array([100, 1, 1, 1]), np.array([], int), 5)
    assert len(found) <= topk.RESOLVE < len(rows)
    want = np.sort(rows @ np.array([100, 1, 1, 1]))[-5:]
    assert (np.sort(scores)[-5:] == want).all()


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the driver's tables")
def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.execute(f"SELECT query_id, rank, vec_id, score FROM ({q_topk.SQL})").fetchall()
    assert got(q_topk.op11_topk(spark, SF)) == set(want) and want
