"""Ridge by Gram sums against plain least squares; folds left out; odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import gram, model

COLS = ["a", "b", "c"]


def plain(x, y, w, alpha=1.0):
    """Ridge with a free intercept, by an augmented least squares problem."""
    mx, my = w @ x / w.sum(), w @ y / w.sum()
    rows = np.vstack(((x - mx) * np.sqrt(w)[:, None], np.sqrt(alpha) * np.eye(x.shape[1])))
    b = np.linalg.lstsq(rows, np.concatenate(((y - my) * np.sqrt(w), np.zeros(x.shape[1]))), rcond=None)[0]
    return my - mx @ b, b


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(6)
    n = 900
    x = rng.normal(size=(n, 3)) * [1, 50, 0.01] + [1000, -3, 5]  # far from the origin
    e, f, w = rng.integers(0, 3, n), rng.integers(0, 4, n), rng.uniform(0.2, 3, n)
    y = x @ [0.3, -0.02, 40] + e + rng.normal(size=n)
    rows = [(["p", "q", None][e[k]], int(f[k]), *map(float, x[k]), float(y[k]), float(w[k])) for k in range(n)]
    odd = [("p", 1, None, 1.0, 1.0, 1.0, 1.0), ("p", 1, float("nan"), 1.0, 1.0, 1.0, 1.0), ("q", 2, 1.0, 1.0, 1.0, float("inf"), 1.0), ("q", 2, 1.0, 1.0, 1.0, 1.0, 0.0), ("q", 2, 1.0, 1.0, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows + odd, "e string, f int, a double, b double, c double, y double, w double").repartition(5)
    return df, np.array(["p", "q", None], object)[e], f, x, y, w


@pytest.mark.parametrize("alpha", [0.0, 1.0, 250.0])
def test_groups_equal_plain_ridge(table, alpha):
    df, e, _, x, y, w = table
    got = {r.e: r for r in gram.ridge_by_group(gram.gram_sums(df, COLS, "y", "w", ["e"]), ["e"], alpha).collect()}
    assert set(got) == {"p", "q", None}
    for name, r in got.items():
        at = e == name
        a, b = plain(x[at], y[at], w[at], alpha)
        assert r.n == at.sum() and np.allclose(r.coefficients, b, rtol=1e-8, atol=1e-10) and abs(r.intercept - a) < 1e-6


def test_folds_equal_fits_without_them(table):
    df, e, f, x, y, w = table
    got = {(r.e, r.f): r for r in gram.ridge_folds(gram.gram_sums(df, COLS, "y", "w", ["e", "f"]), "f", ["e"]).collect()}
    assert len(got) == 12
    for (name, fold), r in got.items():
        at = (e == name) & (f != fold)
        a, b = plain(x[at], y[at], w[at])
        assert r.n == at.sum() and np.allclose(r.coefficients, b, rtol=1e-8, atol=1e-10) and abs(r.intercept - a) < 1e-6


def test_cross_validation_judges_left_out_rows(table):
    df, _, f, x, y, w = table
    clean = df.where("w > 0 and y < 1e300 and not isnan(a) and a <> 1")  # a row of weight 0 teaches nothing but is judged
    for r in model.cross_validate(clean, "f", COLS, "y", "w").collect():
        a, b = plain(x[f != r.f], y[f != r.f], w[f != r.f])
        at = f == r.f
        errors = y[at] - a - x[at] @ b
        assert r.n == at.sum() and abs(r.rmse - np.sqrt(np.mean(errors**2))) < 1e-7


def test_ties_one_fold_and_empty_tables(spark, table):
    df = table[0]
    one = df.where("f = 1")
    assert gram.ridge_folds(gram.gram_sums(one, COLS, "y", "w", ["f"]), "f").count() == 0
    assert gram.ridge_by_group(gram.gram_sums(df.limit(0), COLS, "y", "w", ["e"]), ["e"]).count() == 0
    assert gram.ridge_by_group(gram.gram_sums(df.limit(0), COLS, "y", "w")).count() == 0
    same = spark.createDataFrame([(1.0, 2.0, 5.0, 1.0)] * 6, "a double, b double, y double, w double")
    r = gram.ridge_by_group(gram.gram_sums(same, ["a", "b"], "y", "w"), alpha=0.0).first()
    assert r.coefficients == [0.0, 0.0] and r.intercept == 5.0
    fits = gram.ridge_by_group(gram.gram_sums(df.where("e = 'p'"), COLS, "y", "w", ["e"]), ["e"])
    out = gram.predict_linear(df, fits, COLS, ["e"])
    assert out.where("e <> 'p' and prediction is not null").count() == 0 and out.where("e is null and prediction is not null").count() == 0
    assert out.where(F.col("prediction").isNotNull()).count() == df.where("e = 'p' and a is not null").count()


def test_sums_add_up_and_come_off():
    rng = np.random.default_rng(1)
    z, w = rng.normal(size=(50, 3)) + 1e4, rng.uniform(1, 2, 50)
    a, b = gram.sums_of(z[:20], w[:20]), gram.sums_of(z[20:], w[20:])
    for got, want in ((gram.added(a, b), gram.sums_of(z, w)), (gram.taken_off(gram.added(a, b), b), a)):
        assert got[0] == want[0] and np.allclose(got[2], want[2], rtol=1e-12) and np.allclose(got[3], want[3], rtol=1e-6, atol=1e-6)
    assert gram.taken_off(a, a) is None
