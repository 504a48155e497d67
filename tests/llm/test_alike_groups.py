"""Groups of mutually alike texts: one class each, the same whatever the group's size and the order of its ids."""

import numpy as np

from marlstone.llm import neardup
from test_edges import text_of


def test_groups_of_alike_texts_in_any_order_of_ids(spark):
    rng = np.random.default_rng(11)
    groups = []
    for size in (2, 8, 9, 40, 150):
        origin = text_of(rng, 200).split()
        texts = [" ".join(origin)]
        for k in range(1, size):
            copy = list(origin)
            copy[(7 * k) % 200] = f"changed{k}"
            texts.append(" ".join(copy))
        groups.append(texts)
    flat = [(g, t) for g, texts in enumerate(groups) for t in texts]
    want = {t: len(groups[g]) for g, t in flat}
    for order in (range(len(flat)), range(len(flat) - 1, -1, -1), rng.permutation(len(flat)).tolist()):
        rows = [(int(i), flat[j][1]) for i, j in enumerate(order)]
        group = {i: flat[j][0] for i, j in enumerate(order)}
        first = {g: min(i for i in group if group[i] == g) for g in range(len(groups))}
        got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert len(got) == len(rows)
        assert all(r.class_id == first[group[r.doc_id]] and r.texts == want[rows[r.doc_id][1]] and r.similar for r in got)
