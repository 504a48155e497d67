"""Secret scans of texts with very many matches: right, and without work that grows with their square."""

import time

import numpy as np
from pyspark.sql import functions as F

from marlstone.llm import secrets
from test_llm import base_spans

LETTERS = list(secrets.ENCODINGS[-1][1][:62])


def text_of(rng, n):
    drawn = rng.choice(LETTERS, (n, 42))
    return " ".join(f"password={''.join(x[:12])} {''.join(x[12:])}" for x in drawn)


def blanked(text, spans):
    out, at = [], 0
    for start, _, end in spans:
        out += [text[at:start]] + ["[SECRET]"] * (start >= at)
        at = max(at, end)
    return "".join(out) + text[at:]


def test_ten_thousand_matches_and_runs_in_one_text(spark):
    rng, took = np.random.default_rng(6), {}
    for n in (10, 20, 10_000):  # the first warms the session
        text = text_of(rng, n)
        begun = time.perf_counter()
        table = spark.createDataFrame([(text,)], "text string")
        r = secrets.redact(secrets.scan_secrets(table).withColumn("whole", F.col("text"))).select("whole", "text", "secrets", secrets.span_text(F.col("secrets"), True).alias("base")).first()
        took[n] = time.perf_counter() - begun
        spans = [tuple(s) for s in r.secrets]
        assert r.base == base_spans(text) and r.text == blanked(text, spans)
        assert sum(s[1] == 3 for s in spans) >= 0.95 * n
    assert took[10_000] - took[20] < 5


def test_runs_apart_from_base_spans_equal_all_pairs(spark):
    rng, rows = np.random.default_rng(2), []
    for k in range(60):
        drawn = lambda n, size: [(int(a), int(a + rng.integers(1, size)), "x") for a in rng.integers(0, 400, n)]
        runs, at = [], 0
        while at < 400 and k:
            start = at + int(rng.integers(0, 20))
            at = start + int(rng.integers(1, 12))
            runs.append((start, at, "x"))
        rows.append((k, runs, drawn(k % 15, 3 if k % 2 else 60)))
    span = "array<struct<start:int,end:int,body:string>>"
    got = spark.createDataFrame(rows, f"k int, runs {span}, base {span}").select("k", secrets._apart(F.col("runs"), F.col("base")).alias("free"))
    free = {r.k: [(s.start, s.end) for s in r.free] for r in got.collect()}
    for k, runs, base in rows:
        assert free[k] == [(a, b) for a, b, _ in runs if not any(x < b and a < y for x, y, _ in base)]


def test_running_sums_and_maxima(spark):
    rng = np.random.default_rng(1)
    rows = [([int(x) for x in rng.integers(-9, 9, n)],) for n in (0, 1, 2, 3, 4, 5, 8, 9, 10, 63, 64, 65, 1000)]
    got = spark.createDataFrame(rows, "v array<int>").select("v", secrets._running(F.col("v"), secrets._sum, 0).alias("s"), secrets._running(F.col("v"), F.greatest, -100).alias("m")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.s == np.cumsum(r.v).tolist() and r.m == (np.maximum.accumulate(r.v).tolist() if r.v else [])
