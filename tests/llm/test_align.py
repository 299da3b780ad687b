"""Alignment of two tokenizers against the untouched libraries on whole texts."""

import hashlib
import os
import random
import shutil
from collections import Counter

import public_tokenizers as P
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tapeloom.llm import align, q_align

SF = "/root/testdata/sf0.001"
A_PATH, B_PATH = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
HARD = [None, "", " ", "   ", "\n", " a", "a ", "a  b", "a \n b", "foo\n  bar\t baz", "▁", "x▁y z", "no ▁ here", "été 漢字 🙂 　x", "it's a <|endoftext|> </s> <s> <0x0A>", "\x00\x01\x1c \x85 y", "don't  stop.\r\n\r\n", "a  b", "…—“”", "x" * 500, "word " * 300, "﻿z", "é ﬁ ½", "tab\t\tend "]
NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def plain(docs):
    """The rows of docs (id, text), by the libraries and loops over bytes."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_model, b_model = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    a_model.encode_special_tokens = True
    of = align._byte_of()
    found, counts = [], Counter()
    for i, t in docs:
        own = (" " + (t or "")).encode()
        a = a_model.encode(own.decode(), add_special_tokens=False).ids if t else []
        b = b_model.encode(t, num_threads=1) if t else []
        spell_a = [bytes(of[c] for c in a_model.id_to_token(x)) for x in a]
        spell_b = [bytes([int(p[3:5], 16)]) if b_model.is_byte(x) else p.replace("▁", " ").encode() for x in b for p in [b_model.id_to_piece(x)]]
        if not t or b"".join(spell_a) != own or b"".join(spell_b) != own:
            found.append((i, [], [], [], []))
            continue
        ends_a = [sum(map(len, spell_a[: k + 1])) for k in range(len(a))] if len(a) < 50 else list(_running(spell_a))
        ends_b = list(_running(spell_b))
        both = sorted(set(ends_a) & set(ends_b))
        groups, at_a, at_b = [], 0, 0
        for end in both:
            to_a, to_b = ends_a.index(end, at_a) + 1, ends_b.index(end, at_b) + 1
            groups.append(f"{','.join(map(str, a[at_a:to_a]))}|{','.join(map(str, b[at_b:to_b]))}")
            at_a, at_b = to_a, to_b
        where_b = dict(zip(ends_b, b, strict=True))
        links = [(x, where_b[e]) for e, x in zip(ends_a, a, strict=True) if e in where_b]
        counts.update(links)
        found.append((i, a, b, groups, links))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return sorted(((i, len(a), len(b), len(g), len(x), sum(counts[p] == best[p[1]] for p in x), sum(counts[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for i, a, b, g, x in found), key=str)


def _running(parts):
    n = 0
    for p in parts:
        n += len(p)
        yield n


def got(df):
    return sorted(((r.doc_id, *(r[c] for c in NAMES)) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def random_texts():
    rng, bits = random.Random(7), ["a", "the", " ", "  ", "\n", "\t", "▁", "é", "漢", "'s", "1", "23", ".", " ", "\x1c", "Zug", "-", "ing"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 30))) for _ in range(600)]


@pytest.mark.parametrize("most_links", [1 << 21, 50])
def test_against_the_libraries(spark, random_texts, most_links):
    docs = list(enumerate(HARD + random_texts)) + [(None, "no id"), (3, "a repeated id")] + [(10_000 + i, "the very same line") for i in range(300)]
    df = spark.createDataFrame([(t, i, "x") for i, t in docs], "text string, doc_id long, TEXT2 string").repartition(3)
    assert got(align.align(df, A_PATH, B_PATH, most_links=most_links)) == plain(docs)


def test_clashing_names_and_other_names(spark):
    df = spark.createDataFrame([(1, "one two", "block", 5)], "key long, body string, block string, KEY int")
    assert got(align.align(df, A_PATH, B_PATH, doc_id="key", text="body")) == plain([(1, "one two")])


def test_empty_table(spark):
    assert align.align(spark.createDataFrame([], "doc_id long, text string"), A_PATH, B_PATH).collect() == []


def test_long_text_is_aligned_in_steps_and_the_cache_is_bounded(monkeypatch):
    rng = random.Random(8)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(60_000))
    whole = align.Aligner(A_PATH, B_PATH).documents([text, text[:1000]])
    monkeypatch.setattr(align, "STEP_PARTS", 1000)
    small = align.Aligner(A_PATH, B_PATH, kept_parts=500)
    steps = small.documents([text, text[:1000]])
    assert len(small.known) <= 500
    again = small.documents([text])
    for x, y in [*zip(whole, steps, strict=True), (whole[0], again[0])]:
        assert (x.n_a, x.n_b, x.n_groups, x.digest) == (y.n_a, y.n_b, y.n_groups, y.digest)
        assert (x.pairs == y.pairs).all() and (x.times == y.times).all()


def test_labels():
    import numpy as np

    assert align.labels(6, np.array([2, 6]), np.array([1, 2, 4, 6])) == b"bcnbnc"


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the driver's tables")
def test_query_over_documents(spark, tmp_path):
    for f in os.listdir(SF):
        shutil.copyfile(f"{SF}/{f}", tmp_path / f)
    docs = pq.read_table(f"{SF}/documents.parquet")
    own = {"doc_id": [1 << 40, *range(1 << 41, (1 << 41) + len(HARD) - 1)], "text": HARD}
    more = pa.table({c: pa.array(own.get(c, [None] * len(HARD)), docs.schema.field(c).type) for c in docs.column_names})
    pq.write_table(pa.concat_tables([docs, more]), tmp_path / "documents.parquet", row_group_size=40)
    every = pq.read_table(tmp_path / "documents.parquet")
    assert got(q_align.op12_align(spark, str(tmp_path))) == plain(list(zip(every["doc_id"].to_pylist(), every["text"].to_pylist(), strict=True)))
