"""The latent spaces of decontamination are fitted on every passage of every document."""

import numpy as np
import pyarrow as pa

from marlstone.llm import decontam


def test_spaces_are_fitted_on_all_documents(spark, monkeypatch):
    told = [f"w{k} w{k + 1} w{k + 2}" for k in range(6000)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(told)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "an item of six words only")], "item_id long, text string")
    seen, fit = set(), decontam.randomized_svd

    def watched(rows, features, rank):
        for r in rows.select("at").collect():
            seen.update(r["at"])
        return fit(rows, features, rank)

    monkeypatch.setattr(decontam, "randomized_svd", watched)
    assert not decontam.find_contamination(docs, bench).where("contaminated").count()
    hashes = np.concatenate([b[2] for b in decontam.word_blocks(decontam.text_array(pa.array(told)))])
    cells = set((hashes >> decontam.SHIFT).astype(int).tolist())
    assert len(cells) > 4000 and len(cells - seen) <= 2  # a sum of random signs may be 0


def test_projected_passages_keep_the_weight_of_each_direction(spark):
    many, few = " ".join(f"many{k}" for k in range(64)), " ".join(["few", "few", *(f"few{k}" for k in range(150))])
    docs = spark.createDataFrame([(None, many)] * 3000 + [(k, few) for k in range(1000)] + [(1, None), (2, "")], "doc_id long, text string").repartition(5)
    idf = np.linspace(1, 2, 1 << decontam.BITS).astype(np.float32)
    rows, n = decontam.sketched(docs, idf)
    assert n == 3000 + 4 * 1000 and rows.count() <= decontam.SKETCH
    table = np.zeros((decontam.SKETCH, 1 << decontam.BITS), np.float32)
    for k, r in enumerate(rows.collect()):
        table[k, r["at"]] = r["v"]
    for text, count in ((many, 3000), (few, 1000)):
        for *_, at, v in decontam._passages(decontam.text_array(pa.array([text])), idf):
            held = np.square(table[:, at] @ (v / np.linalg.norm(v))).sum()
            assert 0.6 * count < held < 2.2 * count  # neighbouring passages of a text share half of their words
    assert decontam.sketched(docs.limit(0), idf)[1] == 0
