"""Spelling variants against pairs found by plain edits."""

import os
import random
import re
import shutil
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tapeloom.llm import q_variants, variants

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
NAMES = ("word", "form", "root", "n", "n_near", "form_n")


def words_of(docs):
    n = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    return n


def plain(n, times=5):
    """The rows for words with their counts, by taking out each code point in turn."""
    holes = {}
    for w in n:
        for i in range(len(w)):
            holes.setdefault((w[:i], w[i + 1 :]), []).append(w)
    near = {w: set() for w in n}
    for (a, b), own in holes.items():
        for w in own:
            near[w].update(x for x in own if x != w)
            if a + b in n:
                near[w].add(a + b)
                near[a + b].add(w)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None
    rows = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return rows


def got(df):
    rows = df.collect()
    found = {tuple(r[c] for c in NAMES) for r in rows}
    assert len(found) == len(rows)
    return found


def random_words(letters, seed, most=60_000):
    rng = random.Random(seed)
    return {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 8))): rng.choice([1, 2, 3, 9, 20, 60, 400, most]) for _ in range(1500)}


@pytest.mark.parametrize("letters", ["ab", "abcÿé", "aé漢\U0001f642"])
@pytest.mark.parametrize("sizes", [{}, {"group_words": 20, "task_rows": 300}])
def test_against_plain_edits(spark, letters, sizes):
    n = random_words(letters, 11)
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    assert got(variants.variants(df, **sizes)) == plain(n)


def test_wavelet_reports_each_point_once():
    rng = np.random.default_rng(12)
    values = rng.permutation(77)
    lo, least = rng.integers(0, 77, 200), rng.integers(0, 77, 200)
    hi, most = lo + rng.integers(-3, 40, 200), least + rng.integers(-3, 40, 200)
    hi = np.minimum(hi, 77)
    whose, value = variants.Wavelet(values).report(lo, hi, least, most)
    want = sorted((i, int(v)) for i in range(200) for v in values[lo[i] : max(lo[i], hi[i])] if least[i] <= v < most[i])
    assert sorted(zip(whose.tolist(), value.tolist(), strict=True)) == want


def test_long_chain_of_forms(spark):
    words = ["a" * 6 + "b" * i for i in range(12)]
    n = {w: 5**i for i, w in enumerate(words)}
    found = got(variants.variants(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert found == plain(n) and {r[2] for r in found} == {words[-1]}


HARD = [None, "", "12 34", "Straßenbahn STRASSENBAHN straßenbahn", "x" * 4000, "abcdef " * 9, "abcdeÿ×÷ ÀÉÖ abcdef's naïve-naïve", "École école ÉCOLE " * 4]


def test_hard_documents(spark):
    docs = [(i, t) for i, t in enumerate(HARD)] + [(None, "abcdeg " * 6), (5, HARD[5])] + [(100 + i, "Repeated passage of several lengthy words") for i in range(400)]
    df = spark.createDataFrame([(t, i, 1, "w") for i, t in docs], "text string, doc_id long, N int, word string")
    n = {w: c for w, c in words_of(docs).items() if len(w) >= 6 and c >= 5}
    assert got(variants.group(df)) == plain(n)
    assert len(n) > 5


def test_empty_table(spark):
    assert got(variants.group(spark.createDataFrame([], "doc_id long, text string"))) == set()
    assert got(variants.group(spark.createDataFrame([(1, "once only")], "doc_id long, text string"))) == set()


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the driver's tables")
def test_query_over_documents(spark, tmp_path):
    for f in os.listdir(SF):
        shutil.copyfile(f"{SF}/{f}", tmp_path / f)
    docs = pq.read_table(f"{SF}/documents.parquet")
    own = {"doc_id": [*range(1 << 41, (1 << 41) + len(HARD))], "text": HARD}
    more = pa.table({c: pa.array(own.get(c, [None] * len(HARD)), docs.schema.field(c).type) for c in docs.column_names})
    pq.write_table(pa.concat_tables([docs, more]), tmp_path / "documents.parquet", row_group_size=40)
    every = pq.read_table(tmp_path / "documents.parquet")
    n = {w: c for w, c in words_of(zip(every["doc_id"].to_pylist(), every["text"].to_pylist(), strict=True)).items() if len(w) >= 6 and c >= 5}
    assert got(q_variants.op13_variants(spark, str(tmp_path))) == plain(n) and len(n) > 500
