"""The pipeline's stages by a brute-force version on the smallest table, and the queries with SQL against DuckDB."""

import os
import re

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tapeloom.llm import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="needs the driver's tables")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def duck():
    own = duckdb.connect()
    for f in os.listdir(SF):
        own.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return own


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    got = registry.queries()[name](spark, SF).toPandas()
    want = duck().execute(registry.oracle_sql()[name]).df()[list(got.columns)]
    key = list(got.columns[:2])  # the id, and what tells rows of one id apart
    got, want = (x.sort_values(key).reset_index(drop=True).astype(object).where(lambda d: d.notna(), None) for x in (got, want))
    assert got.map(str).replace(r"\.0$", "", regex=True).equals(want.map(str).replace(r"\.0$", "", regex=True))


def test_stages(spark):
    from tests.llm.test_operators import brute_components, fingerprint

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_duplicates", "decontamination", "secrets", "byte_bpe"]

    kept = stages["language_id"](spark, docs, SF)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert ids == {k for k, r in rows.items() if r.text and re.search(r"[^\W\d_]", r.text)}  # clean documents stay

    kept = stages["near_duplicates"](spark, docs, SF)
    order = sorted(rows)
    groups = brute_components([fingerprint(rows[k].text) for k in order])
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {order[g] for g in groups}

    kept = stages["decontamination"](spark, docs, SF)
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    wins = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        wins |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in wins}
    dirty = {k for k, r in rows.items() if any(tuple(w[i : i + n]) in wins for w in [words(r.text)] for n in sizes for i in range(len(w) - n + 1))}
    assert dirty and {r.doc_id for r in kept.select("doc_id").collect()} == set(rows) - dirty

    masked = {r.doc_id: r for r in stages["secrets"](spark, docs, SF).collect()}
    assert set(masked) == set(rows)
    for k, r in masked.items():
        assert r.n_chars == len(r.text) and not re.search("[0-9a-f]{16}|AKIA[A-Z0-9]{14}", r.text)
        if "[SECRET]" not in r.text:
            assert r.text == rows[k].text


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    rows = out.collect()
    assert rows and len({r.doc_id for r in rows}) == len(rows)
    assert all(len(r.ids) == 4 * r.n_tokens and len(np.frombuffer(r.offsets, "<u4")) == r.n_tokens + 1 for r in rows)


def test_every_query_is_registered():
    assert {re.match(r"op(\d+)_", q)[1] for q in registry.queries() if q.startswith("op")} == {str(n) for n in range(1, 14)}
    assert "pipeline" in registry.queries()
