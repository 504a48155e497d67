"""Letters of whole texts are counted without a regular expression for each letter, and each text is cleaned once."""

import math
import os

from marlstone.operators import model
from marlstone.plans import registry
from marlstone.plans.frames import frame

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_letters_are_counted_from_one_cleaned_text(spark, monkeypatch):
    seen = []

    def watch(df, groups, y, key, repeats):
        seen.append((df, groups))
        return real(df, groups, y, key, repeats=repeats)

    real = model.grouped_importance
    monkeypatch.setattr(model, "grouped_importance", watch)
    monkeypatch.setattr(registry.split, "random_split", lambda *a: 1 / 0)  # importance has a split of its own
    assert registry.QUERIES["m10_importance"](spark, DATA).count() == 5
    df, groups = seen[0]
    cols = [c for g in groups.values() for c in g]
    rows = df.select("doc_id", "y", *cols)
    assert rows._jdf.queryExecution().optimizedPlan().toString().lower().count("regexp_replace") == 1
    texts = {r.doc_id: (r.seq, r.text) for r in frame(spark, DATA, "T").collect()}
    for r in rows.collect():
        seq, text = texts[r.doc_id]
        if seq is None:
            assert all(r[c] is None for c in cols)
            continue
        assert r.n_seq == len(seq) and math.isclose(r.y, math.log(len(text) + 1))
        assert all(r[c] == seq.count(c[2:].upper()) for c in cols if c != "n_seq")


def test_rows_without_numbers_are_left_out(spark):
    rows = [(k, float(k % 7), float(k % 3), float(k % 7)) for k in range(200)]
    odd = [(1000, None, 1.0, 2.0), (1001, 3.0, float("nan"), 2.0), (1002, 3.0, float("inf"), 2.0), (1003, 3.0, None, 2.0)]
    got = [sorted(map(tuple, model.grouped_importance(spark.createDataFrame(r, "k long, a double, b double, y double").coalesce(1), {"a": ["a"], "b": ["b"]}, "y", "k").collect())) for r in (rows, rows + odd)]
    assert len(got[0]) == 2 and all(x[0] == z[0] and all(map(math.isclose, x[1:], z[1:])) for x, z in zip(*got, strict=True))
