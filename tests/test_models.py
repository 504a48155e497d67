"""Staged selection against models of fewer trees, permutation importance against a plain loop."""

import math

import numpy as np
import pytest
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from marlstone.operators import model


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 3))
    y = 2 * x[:, 0] + np.sin(3 * x[:, 1]) + 0.1 * rng.normal(size=600)
    df = spark.createDataFrame([(k, *map(float, x[k]), float(y[k]), 1.0, "valid" if k % 4 == 0 else "train") for k in range(600)], "k long, a double, b double, c double, y double, w double, split string")
    return model.assemble(df, ["a", "b", "c"])


@pytest.fixture(scope="module")
def fitted(rows):
    return GBTRegressor(labelCol="y", weightCol="w", maxIter=9, maxDepth=3, stepSize=0.3, seed=2).fit(model.train_rows(rows, "split"))


def test_staged_predictions_are_those_of_fewer_trees(rows, fitted):
    got = {r.k: r.staged for r in model.staged_predictions(rows, fitted, [1, 4, 9]).collect()}
    for j, n in enumerate((1, 4, 9)):
        for r in model.first_trees(fitted, n).transform(rows).collect():
            assert math.isclose(got[r.k][j], r.prediction, rel_tol=1e-12, abs_tol=1e-12)
    whole = {r.k: r.prediction for r in fitted.transform(rows).collect()}
    assert all(math.isclose(got[k][2], p, abs_tol=1e-12) for k, p in whole.items())
    assert model.staged_predictions(rows.limit(0), fitted, [3]).count() == 0


def test_history_equals_prefix_models_in_all_objectives(rows, fitted):
    history = {(r.split, r.trees): r for r in model.stage_history(rows, fitted, "y", 4, 0.9).collect()}
    assert set(history) == {(s, n) for s in ("train", "valid") for n in (4, 8, 9)}
    for (part, n), r in history.items():
        scored = model.first_trees(fitted, n).transform(rows.where(F.col("split") == part)).select("y", "prediction").collect()
        y, p = (np.array([q[k] for q in scored]) for k in (0, 1))
        e = np.abs(y - p)
        i, j = np.triu_indices(len(y), 1)
        ci = np.mean(np.where(p[i] == p[j], 0.5, (p[i] < p[j]) == (y[i] < y[j]))[y[i] != y[j]])
        assert r.n == len(y) and math.isclose(r.rmse, np.sqrt(np.mean(e**2)), rel_tol=1e-9) and math.isclose(r.mse, np.mean(e**2), rel_tol=1e-9)
        assert math.isclose(r.r2, 1 - np.sum(e**2) / np.sum((y - y.mean()) ** 2), rel_tol=1e-9)
        assert math.isclose(r.ci, ci, rel_tol=1e-9) and math.isclose(r.ae_q, np.quantile(e, 0.9, method="higher"), rel_tol=1e-9)
        k = np.sum(y * p) / np.sum(p * p)
        r2, r02 = 1 - np.sum(e**2) / (np.sum((y - y.mean()) ** 2) + 1e-12), 1 - np.sum((y - k * p) ** 2) / (np.sum((y - y.mean()) ** 2) + 1e-12)
        assert math.isclose(r.rm2, r2 * (1 - np.sqrt(abs(r2 - r02))), rel_tol=1e-9)


@pytest.mark.parametrize("objective", [*model.OBJECTIVES, "R2m-bar", "L2"])
def test_every_objective_picks_its_best_stage(rows, objective):
    best, history = model.fit_boosted(rows, "y", "w", stages=4, every=1, depth=2, objective=objective)
    name = objective.lower().replace("-", "_")
    column, higher = model.OBJECTIVES[model.ALIASES.get(name, name)]
    values = {r.trees: r[column] for r in history.where("split = 'valid'").collect()}
    top = (max if higher else min)(values.values())
    assert len(best.trees) == min(k for k, v in values.items() if abs(v - top) <= 1e-12)


def test_unknown_objective(rows):
    with pytest.raises(KeyError):
        model.fit_boosted(rows, "y", "w", stages=1, objective="nonsense")


def test_importance_equals_a_plain_loop(spark, rows, fitted):
    test = rows.where("split = 'valid'").select("k", "y", "a", "b", "c", F.lit(0.0).alias("group_x"))
    groups = {"one": ["a"], "two": ["b"], "three": ["c"]}
    got = {(r.group, r.repeat): r.mse for r in model.permuted_errors(test, fitted, groups, "y", "k", 5, 11).collect()}
    assert len(got) == 16
    order = [r.k for r in test.withColumn("h", model.hash_key("k", 11)).orderBy("h", "k").collect()]
    held = {r.k: r.asDict() for r in test.collect()}
    n = len(order)
    for (g, r), mse in got.items():
        a, b = model.permutation(n, 11, list(groups).index(g), r) if g else (1, 0)
        assert sorted((a * i + b) % n for i in range(n)) == list(range(n))
        mixed = [(held[k]["y"], *(held[order[(a * i + b) % n]][c] if g and c in groups[g] else held[k][c] for c in "abc")) for i, k in enumerate(order)]
        scored = fitted.transform(model.assemble(spark.createDataFrame(mixed, "y double, a double, b double, c double"), ["a", "b", "c"]))
        assert math.isclose(mse, scored.agg(F.avg((F.col("y") - F.col("prediction")) ** 2)).first()[0], rel_tol=1e-9), (g, r)


def test_importance_shares(rows):
    got = {r.group: r for r in model.grouped_importance(rows.drop("features"), {"one": ["a"], "two": ["b"], "none": ["c"]}, "y", "k", repeats=3).collect()}
    assert math.isclose(sum(r.share for r in got.values()), 1.0) and got["one"].share > got["two"].share > got["none"].share and got["one"].spread >= 0
