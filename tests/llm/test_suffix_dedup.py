"""Suffix arrays by induced sorting, common prefixes, and repeats across documents against plain versions."""

import collections
import hashlib
import random

import numpy as np
import pytest

from marlstone.llm import queries, suffix_dedup
from marlstone.llm.common import mix

DATA = "/root/testdata/sf0.001"


def texts_of_letters():
    rng = np.random.default_rng(8)
    for size in (1, 2, 3, 5, 26, 256):
        for n in (1, 2, 3, 10, 57, 400):
            yield rng.integers(0, size, n)
    yield from (np.zeros(300, np.int64), np.arange(200), np.arange(200)[::-1], np.tile([1, 0], 150), np.tile([0, 1], 150), np.tile([2, 1, 3, 1, 0], 60), np.tile(np.tile([1, 2, 1, 0, 3], 7), 9))
    yield np.frombuffer(b"mmiissiissiippii" * 30, np.uint8)
    fib = ["b", "a"]
    while len(fib[-1]) < 700:
        fib.append(fib[-1] + fib[-2])
    yield np.frombuffer(fib[-1].encode(), np.uint8)


def test_suffix_arrays_equal_sorted_suffixes():
    for text in texts_of_letters():
        raw = text.astype(">u2").tobytes()
        want = sorted(range(len(text)), key=lambda k: raw[2 * k :])
        assert suffix_dedup.suffix_array(text).tolist() == want
    assert len(suffix_dedup.suffix_array(np.zeros(0, np.int64))) == 0


def test_common_prefixes():
    rng = np.random.default_rng(2)
    for text in (rng.integers(97, 99, 500), np.frombuffer(b"abcab" * 80, np.uint8), rng.integers(0, 2, 300)):
        data = text.astype(np.uint8)
        raw, order = data.tobytes(), suffix_dedup.suffix_array(data)
        got = suffix_dedup.common_prefixes(data, order, np.ones(len(data), bool), 50)
        for a, b in zip(order[:-1].tolist(), order[1:].tolist(), strict=True):
            n = next((k for k in range(min(50, len(raw) - b, len(raw) - a)) if raw[a + k] != raw[b + k]), min(50, len(raw) - a, len(raw) - b))
            assert got[b] >= n and (got[b] == n or max(a, b) + n == len(raw))  # past the end stand zeros


def plain(rows, length=50):
    """(n_bytes, n_removed, n_spans, kept_sha256) of each row, from all windows."""
    first = collections.defaultdict(list)
    raws = [(d, (t or "").encode()) for d, t in rows]
    for d, raw in raws:
        if d is not None:
            for k in range(len(raw) - length + 1):
                first[raw[k : k + length]].append(d)
    least = {w: min(ds) for w, ds in first.items()}
    out = []
    for d, raw in raws:
        gone = np.zeros(len(raw) + 1, bool)
        if d is not None:
            for k in range(len(raw) - length + 1):
                if least[raw[k : k + length]] < d:
                    gone[k : k + length] = True
        kept = bytes(b for b, g in zip(raw, gone[:-1].tolist(), strict=True) if not g)
        out.append((len(raw), int(gone.sum()), int(np.sum(gone[1:] < gone[:-1])), hashlib.sha256(kept).hexdigest()))
    return out


def told(df):
    return [(r.n_bytes, r.n_removed, len(r.removed), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in df]


def test_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    want = plain([(r.doc_id, r.text) for r in docs])
    got = {r.doc_id: tuple(r)[1:] for r in queries.op12_suffix_dedup(spark, DATA).collect()}
    assert got == {r.doc_id: w for r, w in zip(docs, want, strict=True)} and sum(w[1] for w in want) > 1000


def odd_rows():
    rng = random.Random(5)
    some = lambda n: "".join(rng.choice("abcdeé 漢\n") for _ in range(n))
    shared, other, line = some(90), some(300), "a line of more than fifty bytes that very many documents hold."
    rows = [(9, None), (8, ""), (7, "short"), (6, "x" * 5000), (5, "x" * 49), (4, "x" * 200), (3, "xy" * 700), (2, "yx" * 60)]
    rows += [(None, shared), (None, other), (20, some(30) + shared), (21, shared + some(20)), (22, some(10) + shared[:70] + some(9)), (23, shared[20:60])]
    rows += [(30, other), (30, other), (31, other), (32, other[:150] + some(40) + other[150:]), (-4, other[100:]), (33, other), (33, other[200:])]
    rows += [(100 + k, some(rng.randint(0, 80)) + line + some(rng.randint(0, 80))) for k in range(60)]
    rows += [(200 + k, some(20) + "exactly 30 bytes in many docs." + some(30)) for k in range(40)]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_nulls_repeats_short_texts_and_hot_grams(spark, monkeypatch, small):
    if small:  # frequent grams told by a sample, crowded grams dealt by window, many shards
        for name, n in (("CROWD", 3), ("SHARD", 2000), ("SEEN", 5)):
            monkeypatch.setattr(suffix_dedup, name, n)
    rows = odd_rows()
    df = spark.createDataFrame([(*r, k, "x") for k, r in enumerate(rows)], "doc_id long, text string, k int, kept string").repartition(6)
    out = suffix_dedup.remove_repeats(df)
    assert out.columns == ["doc_id", "text", "k", "n_bytes", "n_removed", "removed", "kept"]
    got = sorted(out.collect(), key=lambda r: r.k)
    for r, g, w in zip(rows, told(got), plain(rows), strict=True):
        assert g == w, r
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def test_other_lengths(spark):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, k int")
    assert told(sorted(suffix_dedup.remove_repeats(df, 80).collect(), key=lambda r: r.k)) == plain(rows, 80)


def test_runs_of_windows(monkeypatch):
    """Every window of every text stands in one run, those of a run share their gram; cuts by chunk change no gram."""
    rng = np.random.default_rng(1)
    sizes = [0, 10, 49, 50, 51, 500, 0, 70, 3000]
    data = rng.integers(97, 100, sum(sizes)).astype(np.uint8)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    wanted = [k for a, b in zip(bounds[:-1], bounds[1:], strict=True) for k in range(a, b - 49)]
    found = []
    for chunk in (1 << 20, 100, 64):
        monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
        at, n, gram = suffix_dedup.window_runs(data, bounds, 50)
        assert n.max() <= suffix_dedup.RUN
        found.append({int(a) + j: int(g) for a, m, g in zip(at, n, gram, strict=True) for j in range(int(m))})
        assert sorted(found[-1]) == wanted and sum(n) == len(wanted)
    assert found[0] == found[1] == found[2]
    windows = collections.defaultdict(set)
    for k, g in found[0].items():
        windows[data[k : k + 50].tobytes()].add(g)
    assert all(len(g) == 1 for g in windows.values()) and mix(np.zeros(1, np.uint64)) == 0
