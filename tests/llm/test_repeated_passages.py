"""Near-duplicates in large buckets whose members repeat a passage more often than the hub."""

import numpy as np
import pytest

from marlstone.llm import neardup
from test_llm import brute_classes


@pytest.mark.parametrize("times, bands, rows", [((10, 14), 1, 1), ((10, 7, 14), 1, 1), (tuple(range(5, 16)), 12, 4)])  # one band: a hub alone decides
def test_members_that_repeat_a_passage_more_often_than_the_hub(spark, times, bands, rows):
    rng = np.random.default_rng(3)  # its copies fall in the hub's bucket, however often it is repeated
    passage = " ".join(f"p{k}" for k in rng.permutation(40))
    texts = {0: " ".join([passage] * times[0])}
    for k in range(1, 41):  # one word of its own at the end tells the members apart
        texts[k] = " ".join([passage] * times[1:][k % (len(times) - 1)] + [f"own{k}"])
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(table, bands=bands, rows=rows).collect()}
    want = brute_classes(texts)
    assert got == want
