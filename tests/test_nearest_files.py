"""What the nearest search writes and deals out, grams and slices of its vectors."""

import collections
import os
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlstone.functions import shared
from marlstone.operators import nearest, text
from marlstone.plans.frames import frame

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def shuffled(df):
    """Bytes dealt out by the plans of ``df``."""
    plan, total, todo = df._jdf.queryExecution().executedPlan(), 0, []
    todo.append(plan)
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif hasattr(node, "plan") and "QueryStage" in name:
            todo.append(node.plan())
        if name == "Exchange":
            total += node.metrics().apply("shuffleBytesWritten").value()
        for k in range(node.children().size()):
            todo.append(node.children().apply(k))
    return total


@pytest.mark.parametrize("every", [1, 5])
def test_little_is_written_and_no_blocks_are_dealt_out(spark, tmp_path, monkeypatch, every):
    monkeypatch.setattr(shared, "_LOCAL", [f"file://{tmp_path}"])
    df = frame(spark, DATA, "T").select("doc_id", "seq")
    rows = df.collect()
    asked = df if every == 1 else df.where(F.col("doc_id") % every == 0)
    out = text.nearest_similarity(asked, df, "doc_id", "seq", others=True, block=16, part=16)
    assert len(out.collect()) == sum(r.doc_id % every == 0 for r in rows)
    letters = sum(len(r.seq or "") for r in rows)
    assert sum(f.stat().st_size for f in Path(tmp_path).rglob("*.parquet")) < 1.5 * letters
    assert shuffled(out) < letters  # blocks of queries times parts of the reference would be many times that


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7])
def test_grams_come_back(n):
    grams = nearest.Grams(n)
    for t in ("", "a", "abcabcabc", "ÄÖ☃😀" * 9 + "\0\0\0\0", "z" * 300):
        codes, counts = grams.unpack(grams.pack(t))
        want = collections.Counter(t[k : k + n] for k in range(len(t) - n + 1))
        plain = {x.rjust(n, "\0"): c for x, c in want.items()}
        assert sorted(counts.tolist()) == sorted(plain.values()) and len(set(codes.tolist())) == len(plain)
        first, second = grams.counted(t)
        assert codes.tolist() == first.tolist() and counts.tolist() == second.tolist()
        if n <= 3:
            assert ["".join(chr(int(c) >> 21 * k & 0x1FFFFF) for k in reversed(range(n))) for c in codes] == sorted(want)


def test_slices_of_vectors_are_dense_rows():
    at = pa.array([[0, 2], [], [1], [0, 1, 2]], pa.list_(pa.int32()))
    w = pa.array([[1.0, 2.0], [], [3.0], [4.0, 5.0, 6.0]])
    whole = np.array([[1, 0, 2], [0, 0, 0], [0, 3, 0], [4, 5, 6]])
    for k in range(4):
        assert (nearest._dense(at[k : k + 2], w[k : k + 2], 3) == whole[k : k + 2]).all()
