"""Decontamination with thousands of items: no exact or paraphrased copy is lost to the search space's fixed rank."""

import numpy as np

from marlstone.llm import decontam
from test_llm import words


def test_recall_with_thousands_of_items(spark):
    rng = np.random.default_rng(8)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    said = {r.doc_id: words(r.text) for r in docs.collect()}
    long = [k for k, w in sorted(said.items()) if len(w) >= 120]
    items = {}
    for i in range(3000):
        w = said[long[i % len(long)]]
        at = int(rng.integers(len(w) - 38))
        items[i] = (long[i % len(long)], w[at : at + 38])
    planted = []
    for i in range(0, 3000, 10):  # a word changed in every eight
        copy = [f"changed{k}" if k % 8 == 3 else w for k, w in enumerate(items[i][1])]
        around = said[long[(i + 7) % len(long)]]
        planted.append((10**6 + i, " ".join(around[:50] + copy + around[50:100])))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, (_, w) in items.items()], "item_id long, text string")
    table = docs.union(spark.createDataFrame(planted, "doc_id long, text string"))
    got = {r.doc_id: r["items"] for r in decontam.find_contamination(table, bench).collect()}
    exact = [any(x["item_id"] == i and x["lcs"] == 1 for x in got[d]) for i, (d, _) in items.items()]
    # a paraphrase counts where enough of the answer is left: hold it against the same check without any search
    idf = _idf(table)
    due = [k for k, _ in planted if _answer_left(items[k - 10**6][1], idf)]
    near = [any(x["item_id"] == k - 10**6 for x in got[k]) for k in due]
    print("exact", sum(exact), len(exact), "paraphrased", sum(near), len(near), "of", len(planted))
    assert all(exact) and len(due) > 0.9 * len(planted) and all(near)


def _idf(table):
    counts, rows = decontam.bucket_df(table, "text", decontam.BITS)
    return ((np.log((1.0 + rows) / (1.0 + np.minimum(counts, rows))) + 0.05) ** 2).astype(np.float32)


def _answer_left(item, idf):
    import pyarrow as pa

    _, _, hashes, _, _, _ = next(decontam.word_blocks(decontam.text_array(pa.array([" ".join(item)]))))
    order = np.argsort(-idf[(hashes >> decontam.SHIFT).astype(np.int64)], kind="stable")[:13]
    answer = {item[k] for k in order}
    return len(answer & {w for k, w in enumerate(item) if k % 8 != 3}) >= 0.5 * len(answer)


def test_passages_lie_in_their_spaces_and_nothing_is_found_without_them(spark, monkeypatch):
    rng = np.random.default_rng(4)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    told = [w for w in (words(r.text) for r in docs.orderBy("doc_id").collect()) if len(w) >= 60]
    items = []
    for i in range(300):  # short ones, long ones of several passages, and pairs that differ in one word
        w = told[(i // 2 * 2 if i < 40 else i) % len(told)]
        size = 12 if i % 3 else min(len(w), 150)
        at = int(rng.integers(len(w) - size + 1)) if i >= 40 else 0
        part = w[at : at + size]
        items.append(part if i % 2 else ["differs", *part[1:]])
    rare = [" ".join(f"rare{i}x{k}" for k in range(50)) for i in range(len(items))]
    planted = spark.createDataFrame([(10**6 + i, f"{rare[i]} {' '.join(x)} {rare[-1 - i]}") for i, x in enumerate(items)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    spaces, fitted = [], decontam.Space

    def kept(*args):
        spaces.append(fitted(*args))
        return spaces[-1]

    monkeypatch.setattr(decontam, "Space", kept)
    got = {r.doc_id: {x["item_id"] for x in r["items"]} for r in decontam.find_contamination(docs.union(planted), bench).collect()}
    assert all(i in got[10**6 + i] for i in range(len(items)))
    assert len(spaces) > 2 and min(s.held.min() for s in spaces) > 0.9
    monkeypatch.setattr(decontam, "Space", fitted)
    real = decontam.randomized_svd
    monkeypatch.setattr(decontam, "randomized_svd", lambda rows, features, rank: (np.linalg.qr(np.random.default_rng(0).normal(size=(features, rank)))[0].astype(np.float32), None))
    few = bench.where("item_id < 60")
    lost = decontam.find_contamination(docs.union(planted), few).where("contaminated").count()
    monkeypatch.setattr(decontam, "randomized_svd", real)
    assert lost < decontam.find_contamination(docs.union(planted), few).where("contaminated").count() / 2
