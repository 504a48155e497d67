"""Replicate aggregation and summaries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.expr import SIGN_ORDER, finite, p_scale
from marlstone.operators.order import quantiles, quantiles_of


def weighted_percentile(df: DataFrame, keys: Sequence[str], v: str, w: str, q: float = 0.5) -> DataFrame:
    """keys, value: linear interpolation of v over the running share of w, held at the smallest value left of its share.

    Null where the weights add up to nothing. (Two equal weights give the lower value at q = 0.5.)
    """
    rows = df.where(finite(v) & finite(w)).groupBy(*keys, F.col(v).cast("double").alias("__v")).agg(F.sum(F.col(w).cast("double")).alias("__w"))
    part = Window.partitionBy(*keys)
    run = part.orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    cdf = rows.withColumn("__total", F.sum("__w").over(part)).where("__total > 0").withColumn("__cdf", F.sum("__w").over(run) / F.col("__total"))
    order = part.orderBy("__v")
    cdf = cdf.withColumns({"__pv": F.lag("__v").over(order), "__pc": F.lag("__cdf").over(order)})
    hit = cdf.where((F.col("__cdf") >= q - 1e-12) & F.coalesce(F.col("__pc") < q - 1e-12, F.lit(True)))
    step = F.col("__pv") + (F.lit(q) - F.col("__pc")) / (F.col("__cdf") - F.col("__pc")) * (F.col("__v") - F.col("__pv"))
    return hit.select(*keys, F.coalesce(step, F.col("__v")).alias("value"))


def conflicting(df: DataFrame, keys: Sequence[str], endpoint: str, v: str, tolerance: float = 4.0) -> DataFrame:
    """Keys of which one endpoint's p-scale spread (positive values) exceeds ``tolerance``."""
    scale = F.when(finite(v), p_scale(v))
    spread = df.groupBy(*keys, endpoint).agg((F.max(scale) - F.min(scale)).alias("__s"))
    return spread.groupBy(*keys).agg(F.bool_or(F.col("__s") > tolerance).alias("__bad")).where("__bad").select(*keys)


def drop_conflicts(df: DataFrame, keys: Sequence[str], endpoint: str, v: str, tolerance: float = 4.0) -> DataFrame:
    """Rows of keys without conflict; null keys compare as equal."""
    bad = conflicting(df, keys, endpoint, v, tolerance).select(*(F.col(k).alias(f"__{k}") for k in keys))
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return df.join(bad, on, "left_anti")


def sign_summary(df: DataFrame, keys: Sequence[str], sign: str) -> DataFrame:
    """keys, sign_set (in the fixed order, joined by ``|``) and sign (most frequent, ties by that order)."""
    order = F.array_position(F.array(*map(F.lit, SIGN_ORDER)), F.col(sign))
    counts = df.where(order > 0).groupBy(*keys, sign).agg(F.count("*").alias("n"), F.min(order).alias("place"))
    gathered = counts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", F.col(sign).alias("s")))).alias("l"), F.min_by(sign, F.struct(-F.col("n"), "place")).alias("sign"))
    return gathered.select(*keys, F.array_join(F.transform("l", lambda x: x["s"]), "|").alias("sign_set"), "sign")


def replicate_weight(weight: str):
    return F.max(weight) * (1 + F.log10(F.count(weight)))


def numeric_summary(df: DataFrame, keys: Sequence[str], c: str, lo: float, hi: float) -> DataFrame:
    """keys, n, min, median (exact), max, n_outside; null keys are keys."""
    counts = df.groupBy(*keys).agg(F.count(c).alias("n"), F.min(c).alias("min"), F.max(c).alias("max"), F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias("n_outside"))
    middle = quantiles(df, c, [0.5], keys).select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("q")[0].alias("median"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return counts.join(middle, same, "left").select(*keys, "n", "min", "median", "max", "n_outside")


def compact_set(df: DataFrame, keys: Sequence[str], c: str, digits: int = 2, most: int = 5) -> DataFrame:
    """keys, text: distinct rounded values in order joined by ``|``; of more than ``most``: count, smallest, largest."""
    values = df.where(F.col(c).isNotNull()).select(*keys, F.bround(F.col(c).cast("double"), digits).alias("v")).distinct()
    ranked = values.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("v")))
    few = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= most, F.col("v")))), lambda x: F.format_string(f"%.{digits}f", x)), "|")
    many = F.format_string(f"nuniq=%d;min=%.{digits}f;max=%.{digits}f", F.count("v"), F.min("v"), F.max("v"))
    return ranked.groupBy(*keys).agg(F.when(F.count("v") <= most, few).otherwise(many).alias("text"))


def penalty_summary(df: DataFrame, keys: Sequence[str], c: str) -> DataFrame:
    """keys, n, min, mean, max, n_penalised (below 1) and text (compact set)."""
    numbers = df.groupBy(*keys).agg(F.count(c).alias("n"), F.min(c).alias("min"), F.avg(c).alias("mean"), F.max(c).alias("max"), F.count_if(F.col(c) < 1 - 1e-12).alias("n_penalised"))
    return numbers.join(compact_set(df, keys, c), list(keys), "left")


def aggregate_replicates(long: DataFrame, keys: Sequence[str], tolerance: float = 4.0, q: float = 0.5) -> DataFrame:
    """One row for each (keys, endpoint): n, weight, value (weighted percentile), sign_set, sign, p_value.

    long: keys, endpoint, value, weight, sign. Keys with a conflict in any endpoint are dropped; null keys are keys.
    Rows fall together by distinct value first (with a count for each sign), then go once by key: conflicts, running
    shares and signs all come from that one partitioning.
    """
    by = [*keys, "endpoint"]
    usable = finite("value") & finite("weight")
    cells = long.groupBy(*by, F.col("value").cast("double").alias("__v")).agg(
        F.count("value").alias("__n"), F.max("weight").alias("__most"), F.count("weight").alias("__weights"), F.sum(F.when(usable, F.col("weight").cast("double"))).alias("__w"),
        *(F.count_if(F.col("sign") == s).alias(f"__sign{k}") for k, s in enumerate(SIGN_ORDER)),
    )
    cells = cells.repartition(*keys)
    part, order = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("__v")
    scale = F.when(finite("__v"), p_scale("__v"))
    spread = F.max(scale).over(part) - F.min(scale).over(part)
    cells = cells.withColumn("__spread", F.coalesce(spread, F.lit(0.0)))
    cells = cells.withColumn("__conflict", F.max("__spread").over(Window.partitionBy(*keys))).where(F.col("__conflict") <= tolerance)
    weighed = F.col("__w").isNotNull()
    upto = F.sum("__w").over(order.rowsBetween(Window.unboundedPreceding, 0))
    cells = cells.withColumns({"__total": F.sum("__w").over(part), "__upto": upto, "__pv": F.last(F.when(weighed, F.col("__v")), True).over(order.rowsBetween(Window.unboundedPreceding, -1))})
    share, before = F.col("__upto") / F.col("__total"), (F.col("__upto") - F.col("__w")) / F.col("__total")
    first = F.col("__pv").isNull()
    hit = weighed & (F.col("__total") > 0) & (share >= q - 1e-12) & (first | (before < q - 1e-12))
    step = F.when(first, F.col("__v")).otherwise(F.col("__pv") + (F.lit(q) - before) / (share - before) * (F.col("__v") - F.col("__pv")))
    counts = [F.sum(f"__sign{k}").alias(f"__sign{k}") for k in range(len(SIGN_ORDER))]
    out = cells.groupBy(*by).agg(F.sum("__n").alias("n"), (F.max("__most") * (1 + F.log10(F.sum("__weights")))).alias("weight"), F.min(F.when(hit, step)).alias("value"), *counts)
    signs = F.filter(F.array(*(F.struct(F.col(f"__sign{k}").alias("n"), F.lit(-k).alias("place"), F.lit(s).alias("s")) for k, s in enumerate(SIGN_ORDER))), lambda x: x["n"] > 0)
    names = F.nullif(F.array_join(F.transform(signs, lambda x: x["s"]), "|"), F.lit(""))
    return out.select(*by, "n", "weight", "value", names.alias("sign_set"), F.array_max(signs)["s"].alias("sign"), p_scale("value").alias("p_value"))


def profile(df: DataFrame, numeric: Sequence[str], other: Sequence[str] = ()) -> DataFrame:
    """column, stat, value: total, non_null, null_ratio, min, max, mean, sd (sample), q25, median, q75; or total, distinct, non_null."""
    stats = []
    for c in numeric:
        x = F.when(finite(c), F.col(c).cast("double"))
        stats += [(c, "total", F.count("*")), (c, "non_null", F.count(x)), (c, "null_ratio", 1 - F.count(x) / F.count("*")), (c, "min", F.min(x)), (c, "max", F.max(x)), (c, "mean", F.avg(x)), (c, "sd", F.stddev_samp(x))]
    for c in other:
        stats += [(c, "total", F.count("*")), (c, "distinct", F.count_distinct(F.col(c))), (c, "non_null", F.count(c))]
    row = df.agg(*(e.cast("double").alias(f"s{k}") for k, (_, _, e) in enumerate(stats)))
    out = row.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.lit(s).alias("stat"), F.col(f"s{k}").alias("value")) for k, (c, s, _) in enumerate(stats)))))
    if numeric:
        named = row.select(F.explode(F.array(*map(F.lit, numeric))).alias("column"))  # a column without values has nulls
        q = named.join(F.broadcast(quantiles_of(df, numeric, (0.25, 0.5, 0.75))), "column", "left")  # one row a column
        out = out.unionByName(q.select("column", F.inline(F.array(*(F.struct(F.lit(s).alias("stat"), F.get("q", F.lit(k)).alias("value")) for k, s in enumerate(("q25", "median", "q75")))))))
    return out


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """a, b, r over the rows where both are present."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    row = df.agg(*(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{k}") for k, (a, b) in enumerate(pairs)))
    return row.select(F.inline(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs)))))


def distribution_audit(long: DataFrame) -> DataFrame:
    """endpoint, sign: n, share within the endpoint, weight min, max, mean."""
    counts = long.groupBy("endpoint", "sign").agg(F.count("*").alias("n"), F.min("weight").alias("w_min"), F.max("weight").alias("w_max"), F.avg("weight").alias("w_mean"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("endpoint")))


def composition(df: DataFrame, dataset: str, factors: Sequence[str]) -> DataFrame:
    """dataset, factor, level, n and share within (dataset, factor); null is the level ``NA``."""
    cells = F.array(*(F.struct(F.lit(f).alias("factor"), F.coalesce(F.col(f).cast("string"), F.lit("NA")).alias("level")) for f in factors))
    counts = df.select(F.col(dataset).alias("dataset"), F.explode(cells).alias("x")).groupBy("dataset", "x.factor", "x.level").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("dataset", "factor")))


def subset_audit(df: DataFrame, by: Sequence[str], y: str) -> DataFrame:
    stats = df.groupBy(*by).agg(F.count(y).alias("n"), F.avg(y).alias("mean"), F.stddev_samp(y).alias("sd"), F.min(y).alias("min"), F.max(y).alias("max"))
    return stats.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(by[0])))


def reference_stats(df: DataFrame, compound: str, target: str) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.count_distinct(F.col(compound)).alias("n_compounds"), F.count_distinct(F.col(target)).alias("n_targets"), F.count_distinct(F.struct(compound, target)).alias("n_pairs"))


def quantile_spec(df: DataFrame, y: str, by: Sequence[str]) -> DataFrame:
    """by, q05..q95 and iqr (at least 1e-8), exact."""
    out = quantiles(df, y, (0.05, 0.25, 0.5, 0.75, 0.95), by)
    names = ("q05", "q25", "q50", "q75", "q95")
    return out.select(*by, *(F.col("q")[k].alias(n) for k, n in enumerate(names)), F.greatest(F.col("q")[3] - F.col("q")[1], F.lit(1e-8)).alias("iqr"))


def fold_summary(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """metric, mean and population sd over folds, finite values only."""
    cells = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics))
    return df.select(F.inline(cells)).where(finite("v")).groupBy("metric").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.count("v").alias("n"))


def histogram(df: DataFrame, c: str, bins: int) -> DataFrame:
    """bin, lo, hi, n: equal widths between smallest and largest value, the last bin closed; empty bins are left out."""
    ends = df.where(finite(c)).agg(F.min(c).cast("double").alias("a"), F.max(c).cast("double").alias("b"))
    at = F.when(F.col("b") > F.col("a"), F.least(F.lit(bins - 1), F.floor((F.col(c) - F.col("a")) * bins / (F.col("b") - F.col("a"))))).otherwise(F.lit(0)).cast("int")
    width = (F.col("b") - F.col("a")) / bins
    return df.where(finite(c)).crossJoin(F.broadcast(ends)).groupBy(at.alias("bin"), "a", width.alias("w")).agg(F.count("*").alias("n")).select("bin", (F.col("a") + F.col("bin") * F.col("w")).alias("lo"), (F.col("a") + (F.col("bin") + 1) * F.col("w")).alias("hi"), "n")


def grid_counts(df: DataFrame, x: str, y: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """by, x_bin, y_bin, n on one grid between the common smallest and largest value of x and y."""
    rows = df.where(finite(x, y))
    ends = rows.agg(F.least(F.min(x), F.min(y)).cast("double").alias("a"), F.greatest(F.max(x), F.max(y)).cast("double").alias("b"))
    at = lambda c: F.least(F.lit(bins - 1), F.floor((F.col(c) - F.col("a")) * bins / F.greatest(F.col("b") - F.col("a"), F.lit(1e-12)))).cast("int")
    return rows.crossJoin(F.broadcast(ends)).groupBy(*by, at(x).alias("x_bin"), at(y).alias("y_bin")).agg(F.count("*").alias("n"))
