"""Joins that refuse or settle repeated keys."""

import pytest
from pyspark.sql import functions as F

from marlstone.operators import joins, order


def test_repeated_keys_are_refused(spark):
    labels = spark.createDataFrame([(1, 0.5), (2, 0.7), (None, 0.1), (None, 0.2)], "k long, y double")
    preds = spark.createDataFrame([(1, 0.4), (2, 0.6), (3, 0.9)], "k long, p double")
    assert sorted(map(tuple, joins.attach_predictions(labels, preds, "k").collect())) == [(1, 0.5, 0.4), (2, 0.7, 0.6)]
    for a, b, side in ((labels, preds.unionByName(preds.where("k = 2")), "predictions"), (labels.unionByName(labels.where("k = 1")), preds, "labels")):
        with pytest.raises(Exception, match=f"a key of the {side} is not unique"):
            joins.attach_predictions(a, b, "k").collect()
    assert joins.attach_predictions(labels.limit(0), preds, "k").count() == 0


def test_dimension_rows_of_one_key(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (None,)], "k long")
    dim = spark.createDataFrame([(1, "b", 5), (1, "a", 9), (1, "a", 7), (2, None, 1)], "k long, name string, n long")
    got = {r.k: (r.name, r.n) for r in joins.attach_dimension(df, dim.repartition(4), "k", {"name": "none", "n": 0}).collect()}
    assert got == {1: ("a", 7), 2: ("none", 1), 3: ("none", 0), None: ("none", 0)}


def test_key_thresholds(spark):
    df = spark.createDataFrame([(0.5,), (0.5,), (0.7,), (1.0,)], "e double")
    assert [tuple(r) for r in order.error_cdf(df, "e").orderBy("error").collect()] == [(0.5, 2, 50.0, True), (0.7, 1, 75.0, False), (1.0, 1, 100.0, True)]
    assert order.error_cdf(df.where(F.col("e") > 5), "e").count() == 0
