"""Subwords against plain merging, sparse blocks, sampled concordance against the exact one."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import metrics, text


def plain_merges(texts, merges):
    words = collections.Counter(w for t in texts if t for w in t.lower().split())
    parts = {w: list(w) for w in words}
    done = []
    while len(done) < merges:
        pairs = collections.Counter()
        for w, n in words.items():
            for x in zip(parts[w][:-1], parts[w][1:], strict=True):
                pairs[x] += n
        best = min(((-n, x) for x, n in pairs.items() if n > 1), default=None)
        if best is None:
            break
        done.append(best[1])
        for w in words:
            parts[w] = text._joined(parts[w], {best[1]: "".join(best[1])})
    return done


def made_up(seed, n):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choice(["an", "the", "re", "st", "a", "e", "o", "zz", "aaaa"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_two_hundred_merges_equal_plain_merging(spark):
    rng = random.Random(1)
    stems = ["".join(chr(0x4E00 + rng.randrange(400)) for _ in range(rng.randint(2, 3))) for _ in range(250)]
    texts = [" ".join("".join(rng.choice(stems[: rng.randint(1, 250)]) for _ in range(rng.randint(1, 3))) for _ in range(40)) for _ in range(80)] + made_up(1, 10) + [None, "", "aaaaaaa aaaaa aaaaaaa", "x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert text.learn_subwords(df, "t", 200, 40) == plain_merges(texts, 200)


def test_one_merge_a_pass_and_the_end(spark):
    texts = ["abab abab cdcd", "ab q"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for per_pass in (1, 3):
        assert text.learn_subwords(df, "t", 50, per_pass) == plain_merges(texts, 50)
    assert text.learn_subwords(df.limit(0), "t") == []


def test_merges_taken_at_once_are_in_strict_order():
    """Random words: what is taken at once is what one merge at a time takes."""
    rng = random.Random(9)
    for _ in range(150):
        texts = [" ".join("".join(rng.choice("abcdef") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(3, 25)))]
        words = collections.Counter(texts[0].split())
        pairs = collections.Counter()
        for w, n in words.items():
            for x in zip(w[:-1], w[1:], strict=True):
                pairs[x] += n
        ranked = sorted(((a, b, n) for (a, b), n in pairs.items() if n > 1), key=lambda r: (-r[2], r[0], r[1]))
        for size in (3, len(ranked)):
            taken = text.take_in_order(ranked[:size], size >= len(ranked), 10)
            assert taken == plain_merges(texts, len(taken))


def test_joined_runs_from_left_to_right():
    assert text._joined(list("aaaaa"), {("a", "a"): "aa"}) == ["aa", "aa", "a"] and text._joined(["a"], {("a", "a"): "aa"}) == ["a"]


def test_sparse_blocks(spark):
    df = spark.createDataFrame([(1, "x", 2.0, None), (2, "q", 0.0, float("nan")), (3, None, -1.0, 5.0), (4, "y", None, 0.0)], "k long, c string, u double, v double")
    rows = spark.createDataFrame([(1, "b", 0.5), (1, "a", 0.25), (3, "c", 0.0), (3, "b", 1.5), (9, "a", 1.0), (1, "unknown", 1.0)], "k long, term string, weight double")
    vocab = spark.createDataFrame([("c",), ("a",), ("b",)], "term string")
    out = text.sparse_rows(df, "k", [(rows, vocab), (rows.where("k = 3"), vocab.where("term <> 'a'"))], [("c", ["x", "y"])], ["u", "v"])
    got = sorted(map(tuple, out.collect()))
    assert got == [(1, 0, 0.25), (1, 1, 0.5), (1, 5, 1.0), (1, 7, 2.0), (3, 1, 1.5), (3, 3, 1.5), (3, 7, -1.0), (3, 8, 5.0), (4, 6, 1.0)]
    packed = {r.k: (r.indices, r["values"]) for r in text.packed_rows(df, out, "k").collect()}
    assert packed == {1: ([0, 1, 5, 7], [0.25, 0.5, 1.0, 2.0]), 2: ([], []), 3: ([1, 3, 7, 8], [1.5, 1.5, -1.0, 5.0]), 4: ([6], [1.0])}
    assert text.sparse_rows(df.limit(0), "k", [(rows, vocab)], [("c", ["x"])], ["u"]).count() == 0


def test_sampled_concordance_is_near_the_exact_one(spark):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 12, 400) / 2.0
    p = y + rng.normal(size=400) * 2
    df = spark.createDataFrame([(k, float(a), float(round(b, 1))) for k, (a, b) in enumerate(zip(y, p, strict=True))] + [(900, None, 1.0)], "k long, y double, p double")
    exact = metrics.concordance(df, "y", "p").first()
    inside = 0
    for seed in range(20):
        r = metrics.concordance_sampled(df, "k", "y", "p", 4000, seed).first()
        error = math.sqrt(exact.ci * (1 - exact.ci) / r.n_pairs)
        inside += abs(r.ci - exact.ci) <= 4 * error
        share = exact.n_pairs / (400 * 400 / 2)  # of draws with replacement
        assert abs(r.n_pairs / 4000 - share) < 0.05
    assert inside == 20
    assert metrics.concordance_sampled(df.where("k = 3"), "k", "y", "p", 50).first().ci is None
    assert metrics.concordance_sampled(df.limit(0), "k", "y", "p", 50).first().n_pairs == 0


@pytest.mark.parametrize("seed", [0, 1])
def test_draws_are_with_replacement(spark, seed):
    df = spark.range(4).select(F.col("id").alias("k"), F.col("id").cast("double").alias("y"), F.col("id").cast("double").alias("p"))
    r = metrics.concordance_sampled(df, "k", "y", "p", 1000, seed).first()
    assert 650 < r.n_pairs < 850 and r.ci == 1.0
