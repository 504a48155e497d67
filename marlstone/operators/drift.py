"""Distribution shift between two data sets: divergences, distances of distributions, reweighting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.expr import finite, novelty_label, quantile_bin_label, similarity_label
from marlstone.functions.shared import written
from marlstone.operators.agg import composition, quantile_spec
from marlstone.operators.joins import seen_flag
from marlstone.operators.metrics import with_subsets
from marlstone.operators.order import group_sums, prefix_sum, quantiles
from marlstone.operators.text import nearest_similarity


def categorical_shift(df: DataFrame, dataset: str, a: str, b: str, factors: Sequence[str]) -> DataFrame:
    """factor, js (Jensen-Shannon divergence in bits), tv (total variation); a level that is missing counts as 0."""
    shares = composition(df.where(F.col(dataset).isin(a, b)), dataset, factors)
    both = shares.groupBy("factor", "level").agg(F.coalesce(F.max(F.when(F.col("dataset") == a, F.col("share"))), F.lit(0.0)).alias("p"), F.coalesce(F.max(F.when(F.col("dataset") == b, F.col("share"))), F.lit(0.0)).alias("q"))
    m = (F.col("p") + F.col("q")) / 2
    term = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log2(F.when(F.col(x) > 0, F.col(x)) / m)).otherwise(0.0)
    return both.groupBy("factor").agg(F.sum((term("p") + term("q")) / 2).alias("js"), F.sum(F.abs(F.col("p") - F.col("q")) / 2).alias("tv"))


def two_sample(df: DataFrame, dataset: str, a: str, b: str, c: str) -> DataFrame:
    """ks and wasserstein of one variable between two data sets, from one frame of distinct values with running counts."""
    rows = df.where(F.col(dataset).isin(a, b) & finite(c)).groupBy(F.col(c).cast("double").alias("x")).agg(F.count_if(F.col(dataset) == a).alias("na"), F.count_if(F.col(dataset) == b).alias("nb"))
    total = rows.agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb"))
    run = prefix_sum(rows, ["x"], ["na", "nb"]).crossJoin(F.broadcast(total))
    gap = lambda p, q: p / F.col("ta") - q / F.col("tb")
    # The area between the curves is the sum over values of x * (|gap before| - |gap after|): no neighbour is needed.
    before = F.abs(gap(F.col("before_na"), F.col("before_nb")))
    after = F.abs(gap(F.col("before_na") + F.col("na"), F.col("before_nb") + F.col("nb")))
    return run.agg(F.max(after).alias("ks"), F.sum(F.col("x") * (before - after)).alias("wasserstein"))


def ks_p_value(ks: Column, na: Column, nb: Column) -> Column:
    """Two-sided p of the two-sample statistic by its limiting distribution (the series' first 100 terms)."""
    size = F.sqrt(na * nb / (na + nb))
    x = (size + 0.12 + 0.11 / size) * ks
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda a, k: a + F.pow(F.lit(-1.0), k - 1) * F.exp(-2.0 * k * k * x * x))
    return F.when(x < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * series)))


def numeric_shift(df: DataFrame, dataset: str, a: str, b: str, variables: Sequence[str], basis: str | None = None, by: str | None = None) -> DataFrame:
    """variable: n, mean, sd (population) and median of each side, smd (pooled population variance), ks, ks_p, wasserstein.

    basis: a column whose values count once in each data set (unique compounds or targets; the variable's smallest value
    stands for them), else every row counts. by: also one block for each of its few values, named in ``subset``.
    """
    named = with_subsets(df.where(F.col(dataset).isin(a, b)), by)
    cells = F.array(*(F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("x")) for v in variables))
    rows = named.select("subset", F.col(dataset).alias("side"), *([F.col(basis).cast("string").alias("__b")] if basis else []), F.explode(cells).alias("__c"))
    rows = rows.select(*(c for c in rows.columns if c != "__c"), "__c.variable", "__c.x").where(finite("x"))
    if basis:
        own = F.when(F.col("variable") == basis, (F.col("x") + 0.0).cast("string")).otherwise(F.col("__b"))
        rows = rows.groupBy("variable", "subset", "side", own.alias("__b")).agg(F.min("x").alias("x"))
    rows, keys = written(rows.select("variable", "subset", "side", "x")), ["variable", "subset"]
    of = lambda n: F.when(F.col("side") == n, F.col("x"))
    side = lambda n, s: [F.count(of(n)).alias(f"n_{s}"), F.avg(of(n)).alias(f"mean_{s}"), F.stddev_pop(of(n)).alias(f"sd_{s}"), F.var_pop(of(n)).alias(f"v_{s}")]
    s = rows.groupBy(*keys).agg(*side(a, "a"), *side(b, "b"))
    middle = quantiles(rows, "x", [0.5], [*keys, "side"]).groupBy(*keys).agg(*(F.max(F.when(F.col("side") == n, F.col("q")[0])).alias(f"median_{t}") for n, t in ((a, "a"), (b, "b"))))
    counts = rows.groupBy(*keys, "x").agg(F.count_if(F.col("side") == a).alias("na"), F.count_if(F.col("side") == b).alias("nb"))
    run = group_sums(counts, keys, ["x"], ["na", "nb"])
    gap = lambda p, q: F.try_divide(p, F.col("total_na")) - F.try_divide(q, F.col("total_nb"))
    before, after = F.abs(gap(F.col("before_na"), F.col("before_nb"))), F.abs(gap(F.col("before_na") + F.col("na"), F.col("before_nb") + F.col("nb")))
    far = run.groupBy(*keys).agg(F.max(after).alias("ks"), F.sum(F.col("x") * (before - after)).alias("wasserstein"))
    smd = F.try_divide(F.col("mean_b") - F.col("mean_a"), F.sqrt((F.col("v_a") + F.col("v_b")) / 2))
    part = s.join(middle, keys, "left").join(far, keys, "left")
    return part.select("variable", *(["subset"] if by else []), *(f"{x}_{y}" for y in "ab" for x in ("n", "mean", "sd", "median")), smd.alias("smd"), "ks", ks_p_value(F.col("ks"), F.col("n_a"), F.col("n_b")).alias("ks_p"), "wasserstein")


def enrich(df: DataFrame, ref: DataFrame, compound: str, target: str, endpoint: str, y: str, sequence: str, valid: str | None = None, acyclic: str | None = None, scaffold: str | None = None) -> DataFrame:
    """Adds what ``ref`` (the training rows) says of each row: seen_compound, seen_target, seen_pair, scaffold_seen,
    compound_novelty, similarity (of the target's sequence with the nearest in ``ref``, by 3-grams), target_novelty,
    target_length, px_bin and px_distance (of y among the endpoint's training values; null without any).

    valid, acyclic and scaffold name columns of df (scaffold of ref too). Without a column all rows are valid, not acyclic,
    without scaffold; a null in one is false.
    """
    out = seen_flag(seen_flag(seen_flag(df, ref, [compound], "seen_compound"), ref, [target], "seen_target"), ref, [compound, target], "seen_pair")
    if scaffold:
        out = seen_flag(out, ref.where(F.col(scaffold) != ""), [scaffold], "scaffold_seen").withColumn("scaffold_seen", F.col("scaffold_seen") & (F.coalesce(F.col(scaffold), F.lit("")) != ""))
    else:
        out = out.withColumn("scaffold_seen", F.lit(False))
    flag = lambda c, default: F.coalesce(F.col(c), F.lit(False)) if c else F.lit(default)
    texts = df.where(F.col(sequence).isNotNull()).select(F.col(sequence).alias("__s")).distinct().withColumn("__id", F.xxhash64("__s"))
    known = ref.where(F.col(sequence).isNotNull()).select(F.col(sequence).alias("__s")).distinct().withColumn("__id", F.xxhash64("__s"))
    near = texts.join(nearest_similarity(texts, known, "__id", "__s"), "__id").select(F.col("__s").alias(sequence), "similarity")
    spec = quantile_spec(ref, y, [endpoint])
    out = out.join(near, sequence, "left").join(F.broadcast(spec), endpoint, "left")  # one row an endpoint
    out = out.withColumns({"compound_novelty": novelty_label("seen_compound", flag(valid, True), flag(acyclic, False), "scaffold_seen"), "target_novelty": similarity_label("seen_target", "similarity"), "target_length": F.length(sequence)})
    out = out.withColumns({"px_bin": F.when(F.col("q50").isNotNull(), quantile_bin_label(y, F.struct("q05", "q25", "q50", "q75", "q95"))), "px_distance": F.abs(F.col(y) - F.col("q50")) / F.col("iqr")})
    return out.drop("q05", "q25", "q50", "q75", "q95", "iqr")


def standardize_mix(df: DataFrame, dataset: str, base: str, other: str, factors: Sequence[str], error2: str) -> DataFrame:
    """factor, mse_base, mse_other, mse_standardised, the roots of all three (rmse_...), rmse_reduction, gap_removed, percent,
    weight_covered; largest gap removed first.

    The other data set's mean squared error by level, weighted by the base's mix over the levels that both have; a factor
    without such a level has no row. percent is null where the gap is within 1e-12 of nothing. A null level is one.
    """
    cells = F.array(*(F.struct(F.lit(f).alias("factor"), F.coalesce(F.col(f).cast("string"), F.lit("NA")).alias("level")) for f in factors))
    rows = df.where(F.col(dataset).isin(base, other) & finite(error2)).select(dataset, error2, F.explode(cells).alias("x"))
    g = rows.groupBy("x.factor", "x.level").agg(F.count_if(F.col(dataset) == base).alias("nb"), F.count_if(F.col(dataset) == other).alias("no"), F.sum(F.when(F.col(dataset) == base, F.col(error2))).alias("sb"), F.sum(F.when(F.col(dataset) == other, F.col(error2))).alias("so"))
    common = (F.col("nb") > 0) & (F.col("no") > 0)
    s = g.groupBy("factor").agg(F.try_divide(F.sum("sb"), F.sum("nb")).alias("mse_base"), F.try_divide(F.sum("so"), F.sum("no")).alias("mse_other"), F.try_divide(F.sum(F.when(common, F.col("nb") * F.col("so") / F.col("no"))), F.sum(F.when(common, F.col("nb")))).alias("mse_standardised"), F.try_divide(F.sum(F.when(common, F.col("nb"))), F.sum("nb")).alias("weight_covered"))
    removed, gap = F.col("mse_other") - F.col("mse_standardised"), F.col("mse_other") - F.col("mse_base")
    roots = {f"rmse_{x}": F.sqrt(F.greatest(F.col(f"mse_{x}"), F.lit(0.0))) for x in ("base", "other", "standardised")}
    s = s.where("weight_covered > 0").withColumns(roots).withColumns({"rmse_reduction": F.col("rmse_other") - F.col("rmse_standardised"), "gap_removed": removed, "percent": F.when(F.abs(gap) > 1e-12, 100 * removed / gap)})
    return s.select("factor", "mse_base", "mse_other", "mse_standardised", *roots, "rmse_reduction", "gap_removed", "percent", "weight_covered").orderBy(F.desc("gap_removed"), "factor")
