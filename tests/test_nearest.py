"""Nearest texts: the bounded search against all products, recall of the hashed candidates, counts within rows."""

import collections
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import nearest, text
from marlstone.plans.frames import frame

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(rows, n=3, width=8192):
    """{key: (similarity, nearest)} of each row among the others, by all products."""
    first, copies = {}, collections.Counter(t for _, t in rows if t is not None)
    for k, t in rows:
        if t is not None:
            first[t] = min(k, first.get(t, k))
    grams = {t: collections.Counter(t[i : i + n] for i in range(len(t) - n + 1)) for t in first}
    df = collections.Counter(g for c in grams.values() for g in c)
    total = collections.Counter()
    for c in grams.values():
        total.update(c)
    vocab = {g: k for k, g in enumerate(sorted(sorted(total), key=lambda g: -total[g])[:width])}
    texts = [t for t in first if any(g in vocab for g in grams[t])]
    m = np.zeros((len(texts), len(vocab)))
    for k, t in enumerate(texts):
        for g, c in grams[t].items():
            if g in vocab:
                m[k, vocab[g]] = c * (np.log((1 + len(first)) / (1 + df[g])) + 1)
    m /= np.linalg.norm(m, axis=1)[:, None]
    cos = np.round(m @ m.T, 9)
    np.fill_diagonal(cos, -1)
    keys, out = np.array([first[t] for t in texts]), {}
    for k, t in rows:
        if t is not None and copies[t] > 1:
            out[k] = (1.0, None)
        elif t in texts and len(texts) > 1:
            row = cos[texts.index(t)]
            out[k] = (min(1.0, row.max()), int(keys[row == row.max()].min()))
        else:
            out[k] = (0.0, None)
    return out


@pytest.fixture(scope="module")
def rows(spark):
    docs = [(r.doc_id, r.seq) for r in frame(spark, DATA, "T").select("doc_id", "seq").collect()]
    return docs + [(10_001, None), (10_002, ""), (10_003, "AB"), (10_004, docs[0][1]), (10_005, "QQQ"), (10_006, docs[3][1] + "ABC"), (10_007, docs[3][1] + "ABC")]


def test_bounded_search_equals_all_products(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, seq string")
    want = plain(rows)
    got = text.nearest_similarity(df, df, "doc_id", "seq", others=True, block=64, part=50).collect()
    assert len(got) == len(rows)
    for r in got:
        similarity, who = want[r.doc_id]
        assert abs(r.similarity - similarity) < 1e-8 and (who is None or r.nearest == who), r
    searched = sum(1 for s, _ in want.values() if 0 < s < 1)
    assert sum(r.multiplied for r in got) < 0.5 * searched * searched


def test_hashed_candidates_find_nine_of_ten(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, seq string")
    want = plain(rows)
    got = {r.doc_id: r for r in text.nearest_similarity(df, df, "doc_id", "seq", others=True, exact=False, block=64, part=50).collect()}
    assert all(got[k].similarity <= s + 1e-8 for k, (s, _) in want.items())
    found = [abs(got[k].similarity - s) < 1e-8 for k, (s, _) in want.items() if 0 < s < 1]
    assert np.mean(found) >= 0.9


def test_any_basis_gives_the_same_result(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, seq string")
    want = plain(rows)
    for rank in (1, 7):
        got = text.nearest_similarity(df, df, "doc_id", "seq", others=True, rank=rank).collect()
        assert all(abs(r.similarity - want[r.doc_id][0]) < 1e-8 for r in got)


def test_texts_beside_the_reference_and_empty_tables(spark, rows):
    ref = spark.createDataFrame(rows[:100], "doc_id long, seq string")
    asked = [(1, rows[5][1]), (2, rows[150][1]), (3, None), (4, ""), (5, "☃☃☃☃"), (6, rows[150][1])]
    got = {r.doc_id: (r.similarity, r.nearest) for r in text.nearest_similarity(spark.createDataFrame(asked, "doc_id long, seq string"), ref, "doc_id", "seq").collect()}
    assert got[1][0] == 1.0 and got[2] == got[6] and 0 < got[2][0] < 1 and got[3] == got[4] == got[5] == (0.0, None)
    assert text.nearest_similarity(ref.limit(0), ref, "doc_id", "seq").count() == 0
    none = text.nearest_similarity(ref, ref.limit(0), "doc_id", "seq").collect()
    assert len(none) == 100 and all(r.similarity == 0 and r.nearest is None for r in none)


def test_counts_within_rows(spark):
    df = spark.createDataFrame([(1, "abcabca"), (2, None), (3, ""), (4, "zz"), (1, "abc")], "k int, t string")
    grams = text.char_ngrams("t", 2, 3)
    want = collections.Counter((r.k, g) for r in df.select("k", F.explode(grams).alias("g")).collect() for g in [r.g])
    assert {(r.k, r.term): r.tf for r in text.term_counts(df, "k", grams).collect()} == want
    one = text.term_counts(df.where("t <> 'abc'"), "k", grams, unique=True).collect()
    assert {(r.k, r.term): r.tf for r in one} == {x: n for x, n in collections.Counter((r.k, r.g) for r in df.where("t <> 'abc'").select("k", F.explode(grams).alias("g")).collect()).items()}
    assert df.select(F.max(F.size(text.counted(F.array().cast("array<string>")))).alias("n")).first().n == 0


def test_basis_is_orthonormal(spark):
    rng = np.random.default_rng(1)
    rows = [(k, sorted(rng.choice(40, 5, replace=False).tolist()), [float(5**-0.5)] * 5) for k in range(60)] + [(99, [1], [1.0]), (98, [1], [1.0])]
    basis = nearest.fit_basis(spark.createDataFrame(rows, "k long, at array<int>, w array<double>"), "k", 40)
    assert basis.shape[1] <= 40 and np.allclose(basis.T @ basis, np.eye(basis.shape[1]), atol=1e-4)
