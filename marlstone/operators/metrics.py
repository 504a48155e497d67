"""Evaluation metrics: one row for all rows and one for each group, from sums, counts by distinct value and running sums.

``by`` is one grouping column or None. Results carry ``subset``: the group's value as text, or ``overall``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.expr import finite, gaussian_interval, prob_ge
from marlstone.functions.shared import written
from marlstone.operators.order import average_rank, group_sums, prefix_sum, quantile_higher, quantiles, running


def with_subsets(df: DataFrame, by: str | None, overall: bool = True) -> DataFrame:
    """Each row once for ``overall`` and once for its group, as column ``subset`` (map side, no shuffle)."""
    names = ([F.lit("overall")] if overall else []) + ([F.col(by).cast("string")] if by else [])
    return df.withColumn("subset", F.explode(F.array(*names)))


def _means(df: DataFrame, y: str, p: str) -> DataFrame:
    means = df.groupBy("subset").agg(F.avg(y).alias("__my"), F.avg(p).alias("__mp"))
    return df.join(F.broadcast(means), "subset")  # one row a group


def regression_metrics(df: DataFrame, y: str, p: str, by: str | None = None) -> DataFrame:
    """subset, n, rmse, mse, mae, r2 (1 - SSE/SST; null below two rows or without spread), bias, pearson."""
    rows = _means(with_subsets(df.where(finite(y, p)), by), y, p)
    e, dy, dp = F.col(y) - F.col(p), F.col(y) - F.col("__my"), F.col(p) - F.col("__mp")
    sums = rows.groupBy("subset").agg(F.count("*").alias("n"), F.sum(e * e).alias("sse"), F.sum(F.abs(e)).alias("sae"), F.sum(-e).alias("se"), F.sum(dy * dy).alias("syy"), F.sum(dp * dp).alias("spp"), F.sum(dy * dp).alias("syp"))
    r2 = F.when((F.col("n") >= 2) & (F.col("syy") > 0), 1 - F.col("sse") / F.col("syy"))
    r = F.when((F.col("syy") > 0) & (F.col("spp") > 0), F.col("syp") / F.sqrt(F.col("syy") * F.col("spp")))
    return sums.select("subset", "n", F.sqrt(F.col("sse") / F.col("n")).alias("rmse"), (F.col("sse") / F.col("n")).alias("mse"), (F.col("sae") / F.col("n")).alias("mae"), r2.alias("r2"), (F.col("se") / F.col("n")).alias("bias"), r.alias("pearson"))


def spearman(df: DataFrame, y: str, p: str, by: str | None = None) -> DataFrame:
    """subset, spearman: correlation of average ranks, ranked within the subset."""
    rows = with_subsets(df.where(finite(y, p)).select(y, p, *([by] if by else [])), by)
    rows = average_rank(average_rank(rows, y, "ry", ["subset"]), p, "rp", ["subset"])
    return rows.groupBy("subset").agg(F.corr("ry", "rp").alias("spearman"))


def rm2(df: DataFrame, y: str, p: str, by: str | None = None, convention: str = "predictive") -> DataFrame:
    """subset, r2, k, k_inverse, r02, r02_inverse, rm2, rm2_inverse, rm2_mean, rm2_delta.

    r02: 1 - sum (y - k p)^2 / SST of the line through the origin; predictive: r2 = 1 - SSE/(SST + 1e-12); pearson: r^2.
    """
    rows = _means(with_subsets(df.where(finite(y, p)), by), y, p)
    a, b = F.col(y), F.col(p)
    da, db = a - F.col("__my"), b - F.col("__mp")
    s = rows.groupBy("subset").agg(F.sum(a * a).alias("yy"), F.sum(b * b).alias("pp"), F.sum(a * b).alias("yp"), F.sum(da * da).alias("ty"), F.sum(db * db).alias("tp"), F.sum(da * db).alias("c"), F.sum((a - b) * (a - b)).alias("sse"))
    s = s.withColumns({"k": F.try_divide("yp", "pp"), "k_inverse": F.try_divide("yp", "yy")})
    squared = F.try_divide(F.col("c") * F.col("c"), F.col("ty") * F.col("tp"))
    r2 = 1 - F.col("sse") / (F.col("ty") + 1e-12) if convention == "predictive" else squared
    r02 = 1 - (F.col("yy") - 2 * F.col("k") * F.col("yp") + F.col("k") * F.col("k") * F.col("pp")) / (F.col("ty") + 1e-12)
    r02i = 1 - (F.col("pp") - 2 * F.col("k_inverse") * F.col("yp") + F.col("k_inverse") * F.col("k_inverse") * F.col("yy")) / (F.col("tp") + 1e-12)
    s = s.select("subset", r2.alias("r2"), "k", "k_inverse", r02.alias("r02"), r02i.alias("r02_inverse"))
    m = lambda r0: F.col("r2") * (1 - F.sqrt(F.abs(F.col("r2") - F.col(r0))))
    s = s.withColumns({"rm2": m("r02"), "rm2_inverse": m("r02_inverse")})
    return s.withColumns({"rm2_mean": (F.col("rm2") + F.col("rm2_inverse")) / 2, "rm2_delta": F.abs(F.col("rm2") - F.col("rm2_inverse"))})


def _concordant(y: np.ndarray, p: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """(pairs with different y, concordant ones with prediction ties as a half) among weighted points.

    Two labels' ranks differ first in one binary digit. So for each digit the points with the same higher digits form a
    block, in which those with a 0 meet those with a 1: every pair once, and sorted arrays count what lies below.
    """
    y, p, n = np.unique(y, return_inverse=True)[1], np.unique(p, return_inverse=True)[1], n.astype(np.float64)
    span, pairs, good = int(p.max(initial=0)) + 1, 0.0, 0.0
    for digit in range(int(y.max(initial=0)).bit_length()):
        block, upper = (y >> (digit + 1)) * span, (y >> digit) & 1 == 1
        low = np.argsort((block + p)[~upper], kind="stable")
        keys, weights = (block + p)[~upper][low], np.concatenate(([0.0], np.cumsum(n[~upper][low])))
        asked, first = (block + p)[upper], block[upper]
        start, below, tied, end = (weights[np.searchsorted(keys, k, s)] for k, s in ((first, "left"), (asked, "left"), (asked, "right"), (first + span - 1, "right")))
        pairs += float(n[upper] @ (end - start))
        good += float(n[upper] @ ((below + tied) / 2 - start))
    return pairs, good


def concordance(df: DataFrame, y: str, p: str, by: str | None = None) -> DataFrame:
    """n_pairs and ci (with ``by``: of each subset, overall included): exact share of pairs with different labels that the predictions order alike (ties count a half).

    Rows fall together by distinct (y, p) and into a grid of label by prediction buckets of about as many points each,
    as many buckets as the square root of the points' number asks for. A value that would fill a bucket has one of its
    own, so that no task grows with a tie. Pairs of points in different label and different prediction buckets are
    counted from the grid's counts alone, those in one heavy prediction bucket (all ties) too; the rest bucket by bucket.
    """
    points = with_subsets(df.where(finite(y, p)), by).groupBy("subset", F.col(y).cast("double").alias("y"), F.col(p).cast("double").alias("p")).agg(F.count("*").alias("n"))
    points = written(points)
    sizes = points.groupBy("subset").agg(F.count("*").alias("many"))
    cells = max(4, math.isqrt(sizes.agg(F.max("many")).first()[0] or 0) // 16)

    def buckets(c: str, name: str) -> DataFrame:
        width = F.greatest(F.lit(1.0), F.col("n") / cells)
        return running(points, c, ["subset"]).select("subset", F.col("value").alias(c), (2 * F.floor(F.col("before") / width) + (F.col("k") >= width).cast("int")).cast("int").alias(name))

    placed = written(points.join(buckets("y", "by"), ["subset", "y"]).join(buckets("p", "bp"), ["subset", "p"]))
    side = 2 * cells + 2
    spots = df.sparkSession.range(side * side).select(F.floor(F.col("id") / side).cast("int").alias("by"), (F.col("id") % side).cast("int").alias("bp")).crossJoin(F.broadcast(sizes.select("subset")))
    grid = spots.join(placed.groupBy("subset", "by", "bp").agg(F.sum("n").alias("n")), ["subset", "by", "bp"], "left").fillna(0, ["n"])
    before = lambda part, order: Window.partitionBy("subset", part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumn("lower", F.coalesce(F.sum("n").over(before("bp", "by")), F.lit(0)))
    grid = grid.withColumns({"less": F.coalesce(F.sum("lower").over(before("by", "bp")), F.lit(0)), "all": F.sum("lower").over(Window.partitionBy("subset", "by"))})
    ties = F.when(F.col("bp") % 2 == 1, F.col("n") * F.col("lower")).otherwise(0)  # a heavy prediction's own bucket
    across = grid.groupBy("subset").agg(F.sum(F.col("n") * (F.col("all") - F.col("lower")) + ties).cast("double").alias("pairs"), F.sum(F.col("n") * F.col("less") + ties / 2).cast("double").alias("good"))

    def in_label(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(pdf.subset.iloc[0], *_concordant(pdf.y.to_numpy(), pdf.p.to_numpy(), pdf.n.to_numpy()))], columns=["subset", "pairs", "good"])

    def in_prediction(pdf: pd.DataFrame) -> pd.DataFrame:  # label buckets are in the labels' order
        return pd.DataFrame([(pdf.subset.iloc[0], *_concordant(pdf.by.to_numpy(), pdf.p.to_numpy(), pdf.n.to_numpy()))], columns=["subset", "pairs", "good"])

    kind = "subset string, pairs double, good double"
    parts = across.union(placed.where("by % 2 = 0").groupBy("subset", "by").applyInPandas(in_label, kind))
    parts = parts.union(placed.where("bp % 2 = 0").groupBy("subset", "bp").applyInPandas(in_prediction, kind))
    return parts.groupBy(*(["subset"] if by else [])).agg(F.coalesce(F.sum("pairs").cast("long"), F.lit(0)).alias("n_pairs"), F.try_divide(F.sum("good"), F.sum("pairs")).alias("ci"))


def concordance_sampled(df: DataFrame, key: str, y: str, p: str, n: int = 500_000, seed: int = 0) -> DataFrame:
    """n_pairs and ci, estimated from n pairs drawn with replacement; pairs of a row with itself and label ties are dropped.

    The rows get places 0, 1, 2 ... by running sums in the order of a hash of ``key``; draw k is the pair of two places that
    k's hashes give, looked up by two joins on the place. Fewer than two rows, or ties alone, give null.
    """
    rows = df.where(finite(y, p)).select(F.col(key).alias("k"), F.col(y).cast("double").alias("y"), F.col(p).cast("double").alias("p"))
    placed = prefix_sum(rows.withColumns({"h": F.xxhash64("k", F.lit(seed)), "one": F.lit(1)}), ["h", "k", "y", "p"], ["one"])
    placed = written(placed.select(F.col("before_one").alias("place"), "y", "p"))
    total = max(placed.count(), 1)
    place = lambda s: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(s)), F.lit(total))
    draws = df.sparkSession.range(n).select(place(1).alias("i"), place(2).alias("j")).where("i <> j")
    side = lambda name, at: placed.select(F.col("place").alias(at), F.col("y").alias(f"y_{name}"), F.col("p").alias(f"p_{name}"))
    pairs = draws.join(side("i", "i"), "i").join(side("j", "j"), "j").where("y_i <> y_j")
    good = F.when(F.col("p_i") == F.col("p_j"), 0.5).when((F.col("p_i") < F.col("p_j")) == (F.col("y_i") < F.col("y_j")), 1.0).otherwise(0.0)
    return pairs.agg(F.count("*").alias("n_pairs"), F.avg(good).alias("ci"))


def abs_error_shares(df: DataFrame, y: str, p: str, thresholds=(0.5, 1.0, 1.5), by: str | None = None, q: float = 0.9) -> DataFrame:
    """subset, share of rows with an absolute error within each threshold, and the error's "higher" quantile as ae_q<100 q>."""
    rows = with_subsets(df.where(finite(y, p)).withColumn("__e", F.abs(F.col(y) - F.col(p))), by)
    shares = [F.avg((F.col("__e") <= t).cast("double")).alias(f"within_{str(t).replace('.', '_')}") for t in thresholds]
    out = rows.groupBy("subset").agg(*shares)
    return out.join(quantile_higher(rows, "__e", q, ["subset"]).select("subset", F.col("value").alias(f"ae_q{round(100 * q)}")), "subset")


def _score_counts(df: DataFrame, label: Column, score: str, by: str | None) -> DataFrame:
    """subset, pos, neg, tp, fp (with the score or a higher one), P, N of each distinct score of each subset."""
    rows = with_subsets(df.where(finite(score)), by).groupBy("subset", (-F.col(score)).alias("s")).agg(F.sum(label.cast("long")).alias("pos"), F.count("*").alias("all"))
    rows = group_sums(rows.select("subset", "s", "pos", (F.col("all") - F.col("pos")).alias("neg")), ["subset"], ["s"], ["pos", "neg"])
    return rows.select("subset", "pos", "neg", (F.col("before_pos") + F.col("pos")).alias("tp"), (F.col("before_neg") + F.col("neg")).alias("fp"), F.col("total_pos").alias("P"), F.col("total_neg").alias("N"))


def roc_auc(df: DataFrame, label: Column, score: str, by: str | None = None) -> DataFrame:
    """subset, auc: trapezoids over distinct scores; null with a single class."""
    c = _score_counts(df, label, score, by)
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    return c.groupBy("subset").agg(F.try_divide(area, F.max(F.col("P") * F.col("N"))).alias("auc"))


def pr_auc(df: DataFrame, label: Column, score: str, method: str = "step", by: str | None = None) -> DataFrame:
    """subset, aupr: average precision (step), or trapezoids from (recall 0, precision 1); ties in score go together."""
    c = _score_counts(df, label, score, by).withColumn("precision", F.col("tp") / (F.col("tp") + F.col("fp")))
    if method == "step":
        cell = F.col("precision") * F.col("pos")
    else:
        higher = F.col("tp") - F.col("pos") + F.col("fp") - F.col("neg")
        before = F.when(higher > 0, (F.col("tp") - F.col("pos")) / higher).otherwise(1.0)
        cell = (F.col("precision") + before) / 2 * F.col("pos")
    return c.groupBy("subset").agg(F.try_divide(F.sum(cell), F.max("P")).alias("aupr"))


def ece(df: DataFrame, label: Column, prob: str, bins: int = 20, by: str | None = None) -> DataFrame:
    rows = with_subsets(df.where(finite(prob)), by).withColumn("__b", F.least(F.lit(bins - 1), F.floor(F.col(prob) * bins)))
    cells = rows.groupBy("subset", "__b").agg(F.count("*").alias("n"), F.avg(label.cast("double")).alias("y"), F.avg(prob).alias("q"))
    return cells.groupBy("subset").agg((F.sum(F.col("n") * F.abs(F.col("y") - F.col("q"))) / F.sum("n")).alias("ece"))


def probability_scores(df: DataFrame, label: Column, prob: str, by: str | None = None) -> DataFrame:
    """subset, brier, log_loss (probabilities kept 1e-15 off 0 and 1)."""
    y, q = label.cast("double"), F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col(prob)))
    return with_subsets(df.where(finite(prob)), by).groupBy("subset").agg(F.avg((F.col(prob) - y) * (F.col(prob) - y)).alias("brier"), (-F.avg(y * F.log(q) + (1 - y) * F.log(1 - q))).alias("log_loss"))


def interval_metrics(df: DataFrame, y: str, lo: str, hi: str, by: str | None = None) -> DataFrame:
    rows = with_subsets(df.where(finite(y, lo, hi)), by)
    width, d = F.col(hi) - F.col(lo), lambda c: F.avg(c.cast("double"))
    return rows.groupBy("subset").agg(F.count("*").alias("n"), d((F.col(y) >= F.col(lo)) & (F.col(y) <= F.col(hi))).alias("coverage"), F.avg(width).alias("width_mean"), d(F.col(y) < F.col(lo)).alias("below"), d(F.col(y) > F.col(hi)).alias("above")).join(quantiles(rows.select("subset", width.alias("__w")), "__w", [0.5], ["subset"]).select("subset", F.col("q")[0].alias("width_median")), "subset", "left")


def coverage_metrics(df: DataFrame, y: str, p: str, half: str, level: Column, by: list[str]) -> DataFrame:
    """by: n, covered, coverage, gap, Wilson bounds, widths, rmse, mae and interval score."""
    z = 1.959963984540054
    e = F.abs(F.col(y) - F.col(p))
    score = 2 * F.col(half) + F.greatest(F.lit(0.0), e - F.col(half)) * 2 / (1 - level)
    s = df.where(finite(y, p, half)).groupBy(*by).agg(F.count("*").alias("n"), F.count_if(e <= F.col(half)).alias("covered"), F.max(level).alias("__l"), F.avg(2 * F.col(half)).alias("width_mean"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("mae"), F.avg(score).alias("interval_score"))
    s = s.join(quantiles(df.where(finite(y, p, half)).select(*by, (2 * F.col(half)).alias("__x")), "__x", (0.5, 0.9), by, "__w"), list(by))
    c, n = F.col("covered") / F.col("n"), F.col("n")
    mid, half_w = (c + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(c * (1 - c) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return s.select(*by, "n", "covered", c.alias("coverage"), (c - F.col("__l")).alias("gap"), (mid - half_w).alias("wilson_lo"), (mid + half_w).alias("wilson_hi"), "width_mean", F.col("__w")[0].alias("width_median"), F.col("__w")[1].alias("width_p90"), "rmse", "mae", "interval_score")


def width_distribution(df: DataFrame, width: str, by: list[str]) -> DataFrame:
    ps = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
    s = df.where(finite(width)).groupBy(*by).agg(F.count("*").alias("n"), F.avg(width).alias("mean"), F.stddev_pop(width).alias("sd"), F.min(width).alias("min"), F.max(width).alias("max")).join(quantiles(df.where(finite(width)), width, ps, by, "__q"), list(by))
    return s.select(*by, "n", "mean", "sd", "min", "max", *(F.col("__q")[k].alias(f"p{round(100 * q):02d}") for k, q in enumerate(ps)))


def uncertainty_quality(df: DataFrame, y: str, p: str, sigma: str, by: str | None = None) -> DataFrame:
    """subset, n, pearson and spearman of sigma with the absolute error, means; below three rows left out."""
    rows = df.where(finite(y, p, sigma)).withColumn("__e", F.abs(F.col(y) - F.col(p)))
    a = with_subsets(rows, by).groupBy("subset").agg(F.count("*").alias("n"), F.corr(sigma, "__e").alias("pearson"), F.avg(sigma).alias("sigma_mean"), F.avg("__e").alias("error_mean"))
    return a.where("n >= 3").join(spearman(rows, sigma, "__e", by), "subset")


def prevalence(df: DataFrame, label: Column, accepted: Column, by: str | None = None) -> DataFrame:
    return with_subsets(df, by).groupBy("subset").agg(F.count("*").alias("n"), F.avg(label.cast("double")).alias("positive_rate"), F.avg(accepted.cast("double")).alias("accepted_rate"), F.count_if(accepted).alias("n_accepted"))


def metric_pack(df: DataFrame, y: str, p: str, threshold: float, by: str | None = None, q: float = 0.99) -> DataFrame:
    """One row a subset: n, rmse, mse, mae, r2, bias, pearson and spearman with their p-values, the Rm2 block (rm2,
    rm2_inverse, rm2_mean, rm2_delta, r02, r02_inverse, k, k_inverse), error shares and quantile ae_q<100 q>, q_used,
    ci (exact), auc and aupr of y >= threshold."""
    label, rows = F.col(y) >= threshold, df.where(finite(y, p))
    out = regression_metrics(df, y, p, by)
    for part in (spearman(df, y, p, by), rm2(df, y, p, by).drop("r2"), abs_error_shares(df, y, p, by=by, q=q), concordance(df, y, p, by).drop("n_pairs") if by else concordance(df, y, p).select(F.lit("overall").alias("subset"), "ci"), roc_auc(rows, label, p, by), pr_auc(rows, label, p, by=by)):
        out = out.join(part, "subset", "left")
    return out.withColumns({"pearson_p": correlation_p("pearson", "n"), "spearman_p": correlation_p("spearman", "n"), "q_used": F.lit(float(q))})


def prediction_summary(df: DataFrame, y: str, p: str, sigma: str, lo: str, hi: str, endpoint: str, split: str, qs=(0.5, 0.9, 0.95)) -> DataFrame:
    """section, name, value: what a user of scored rows looks at first.

    counts (rows, valid, with_interval, with_sigma), the metric block of the valid rows, mean and quantiles of absolute
    error, half-width and sigma, and counts by endpoint and by split (null: ``NA``). One pass for the sums, one running
    count for each quantile block.
    """
    valid, bounded = finite(y, p), finite(lo, hi) & (F.col(hi) >= F.col(lo))
    rows = df.withColumns({"__e": F.when(valid, F.abs(F.col(y) - F.col(p))), "__h": F.when(bounded, (F.col(hi) - F.col(lo)) / 2), "__s": F.when(finite(sigma), F.col(sigma).cast("double"))})
    sides = {"__e": "abs_error", "__h": "half_width", "__s": "sigma"}
    cells = [("counts", "rows", F.count("*")), ("counts", "valid", F.count("__e")), ("counts", "with_interval", F.count("__h")), ("counts", "with_sigma", F.count("__s")), *((n, "mean", F.avg(c)) for c, n in sides.items())]
    told = lambda d, parts: d.select(F.inline(F.array(*(F.struct(F.lit(a).alias("section"), F.lit(b).alias("name"), v.cast("double").alias("value")) for a, b, v in parts))))
    out = told(rows.agg(*(x.alias(f"s{k}") for k, (_, _, x) in enumerate(cells))), [(a, b, F.col(f"s{k}")) for k, (a, b, _) in enumerate(cells)])
    measures = ["rmse", "mae", "r2", "bias", "pearson"]
    out = out.union(told(regression_metrics(df, y, p), [("metrics", m, F.col(m)) for m in measures]))
    for c, n in sides.items():
        out = out.union(told(quantiles(rows, c, qs), [(n, f"q{round(100 * q)}", F.get("q", F.lit(k))) for k, q in enumerate(qs)]))
    for kind, c in (("endpoint", endpoint), ("split", split)):
        out = out.union(df.groupBy(F.coalesce(F.col(c).cast("string"), F.lit("NA")).alias("name")).agg(F.count("*").cast("double").alias("value")).select(F.lit(kind).alias("section"), "name", "value"))
    return out


def export_predictions(df: DataFrame, y: str, p: str, sigma: str, threshold: float, level: float = 0.9) -> DataFrame:
    """Adds the columns of an export row: abs_err, pred_lo, pred_hi (Gaussian interval), prob_strong, label (1 from 0.5 on)."""
    interval, prob = gaussian_interval(p, sigma, level), prob_ge(p, sigma, threshold)
    return df.withColumns({"abs_err": F.abs(F.col(y) - F.col(p)), "pred_lo": interval["lo"], "pred_hi": interval["hi"], "prob_strong": prob, "label": (prob >= 0.5).cast("int")})


def correlation_p(r: str, n: str) -> Column:
    """Two-sided p of a correlation under normality: Student's t with n - 2 degrees; null below three rows.

    p = I_x(d/2, 1/2) with x = 1 - r^2, d = n - 2: a continued fraction (whichever of the two converges fast), and
    gamma(a + 1/2) / gamma(a) by its asymptotic series after eight steps of recurrence.
    """
    d = F.col(n) - F.lit(2.0)
    a, b, x = d / 2, F.lit(0.5), F.greatest(F.lit(0.0), 1 - F.col(r) * F.col(r))
    far = a + 8
    ratio = F.log(far) / 2 - 1 / (8 * far) + 1 / (192 * F.pow(far, F.lit(3.0))) - 1 / (640 * F.pow(far, F.lit(5.0)))
    for k in range(8):
        ratio = ratio + F.log((a + k) / (a + k + 0.5))
    inside = (x > 0) & (x < 1)
    safe = F.when(inside, x).otherwise(0.5)
    front = F.exp(ratio - math.log(math.sqrt(math.pi)) + a * F.log(safe) + b * F.log(1 - safe))

    def fraction(z: Column, s: Column, t: Column) -> Column:
        solid = lambda v: F.when(F.abs(v) < 1e-300, F.lit(1e-300)).otherwise(v)

        def step(acc: Column, m: Column) -> Column:
            even, odd = m * (t - m) * z / ((s + 2 * m - 1) * (s + 2 * m)), -(s + m) * (s + t + m) * z / ((s + 2 * m) * (s + 2 * m + 1))
            one = lambda g, top: F.struct((F.lit(1.0) / solid(1 + top * g["h"])).alias("h"), solid(1 + top / g["c"]).alias("c"), g["e"].alias("e"))
            grown = lambda g: F.struct(g["h"].alias("h"), g["c"].alias("c"), (g["e"] * g["c"] * g["h"]).alias("e"))
            half = F.transform(F.array(grown(one(acc, even))), lambda g: grown(one(g, odd)))  # an array of one names the first half
            return F.get(half, F.lit(0))

        h = F.lit(1.0) / solid(1 - (s + t) * z / (s + 1))
        init = F.struct(h.alias("h"), F.lit(1.0).alias("c"), h.alias("e"))
        return F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(200)), lambda m: m.cast("double")), init, step)["e"]

    low = front * fraction(safe, a, b) / a
    high = 1 - front * fraction(1 - safe, b, a) / b
    p = F.when(safe < (a + 1) / (a + 2.5), low).otherwise(high)
    return F.when((F.col(n) >= 3) & F.col(r).isNotNull(), F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(p))
