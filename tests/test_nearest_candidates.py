"""Candidates come from the heads where they stand: no vectors are dealt out to hash tables."""

import os

from marlstone.operators import nearest, text
from marlstone.plans.frames import frame

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_candidates_deal_out_no_vectors(spark, monkeypatch):
    kept = []
    real = nearest.written
    monkeypatch.setattr(nearest, "written", lambda df, *a: kept.append(df.columns) or real(df, *a))
    df = frame(spark, DATA, "T").select("doc_id", "seq")
    got = {r.doc_id: r for r in text.nearest_similarity(df, df, "doc_id", "seq", others=True, exact=False, block=16, part=16).collect()}
    assert not any("w" in columns or "head" in columns for columns in kept)  # before: heads and weights of both sides, and of each pair
    exact = text.nearest_similarity(df, df, "doc_id", "seq", others=True, block=16, part=16).collect()
    assert len(got) == len(exact) and all(got[r.doc_id].similarity <= r.similarity + 1e-9 for r in exact)
    assert sum(abs(got[r.doc_id].similarity - r.similarity) < 1e-9 for r in exact) >= 0.9 * len(exact)
