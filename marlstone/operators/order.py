"""Order: global running sums without a single-partition window, order statistics, ranks, bins, top-k."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.shared import written


def prefix_sum(df: DataFrame, order: Sequence[str], values: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Adds ``before_<v>``: the sum of v over all rows before this one in ascending ``order`` (ties in one range).

    Rows are dealt by ranges and written; each range is summed in place and the ranges' totals (one row each) are sent to all. Rows
    that tie in ``order`` get running sums in no fixed order: reduce to distinct keys first where that matters.
    """
    spark = df.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # Written once: the ranges come from a sample and would not be the same if both branches dealt the rows out.
    dealt = written(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()))
    totals = dealt.groupBy("__part").agg(*(F.sum(v).alias(f"__t_{v}") for v in values))
    upto = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    bases = totals.select("__part", *(F.coalesce(F.sum(f"__t_{v}").over(upto), F.lit(0)).alias(f"__b_{v}") for v in values))
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    run = dealt.select("*", *(F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"__r_{v}") for v in values))
    out = run.join(F.broadcast(bases), "__part")
    return out.withColumns({f"before_{v}": F.col(f"__r_{v}") + F.col(f"__b_{v}") for v in values}).drop("__part", *(f"__{k}_{v}" for k in "rb" for v in values))


def group_sums(df: DataFrame, by: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Adds before_<v> (sum of v over the group's earlier rows in ``order``) and total_<v> (over the whole group); v >= 0.

    No group is gathered in one task, as a window over it would do: running sums go over all rows in order of group and
    ``order``, and each group's first one is taken off. Null is a group of its own.
    """
    run = prefix_sum(df, [*by, *order], values)
    ends = run.groupBy(*(F.col(b).alias(f"__g_{b}") for b in by)).agg(*(F.min(f"before_{v}").alias(f"__s_{v}") for v in values), *(F.sum(v).alias(f"total_{v}") for v in values))
    out = run.join(ends, reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"__g_{b}")) for b in by])) if by else run.crossJoin(F.broadcast(ends))
    return out.withColumns({f"before_{v}": F.col(f"before_{v}") - F.col(f"__s_{v}") for v in values}).drop(*(f"__g_{b}" for b in by), *(f"__s_{v}" for v in values))


def rank_within(df: DataFrame, stratum: str, order: Sequence[str], name: str) -> DataFrame:
    """Adds the 1-based rank within each of a few large strata. ``order`` must be total."""
    ranked = group_sums(df.withColumn("__one", F.lit(1)), [stratum], order, ["__one"])
    return ranked.withColumn(name, F.col("before___one") + 1).drop("__one", "before___one", "total___one")


def running(df: DataFrame, c: str, by: Sequence[str] = ()) -> DataFrame:
    """by, value, k (rows with that value), before (rows of the group with a smaller one), n (rows of the group); nulls left out."""
    counts = df.where(F.col(c).isNotNull()).groupBy(*by, F.col(c).alias("value")).agg(F.count("*").alias("k"))
    return group_sums(counts, by, ["value"], ["k"]).select(*by, "value", "k", F.col("before_k").alias("before"), F.col("total_k").alias("n"))


def value_counts(df: DataFrame, c: str) -> DataFrame:
    """value, n, before (rows with a smaller value) of each distinct non-null value; one row a value."""
    counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n"))
    return prefix_sum(counts, ["value"], ["n"]).withColumnRenamed("before_n", "before")


def order_stat(df: DataFrame, c: str, position: Column, by: Sequence[str] = ()) -> DataFrame:
    """The value at a 1-based position computed from ``n`` (count of non-null values): globally, or for each group."""
    run = running(df, c, by)
    return run.where(F.col("before") + F.col("k") >= position).groupBy(*by).agg(F.min("value").alias("value"), F.max("n").alias("n"))


def quantiles(df: DataFrame, c: str, qs: Sequence[float], by: Sequence[str] = (), name: str = "q") -> DataFrame:
    """by and ``name``: array of exact quantiles, linear between the two nearest rows, of the non-null values.

    From running counts of distinct values, so that no task or buffer holds all of a group's. No values: no row (one
    row with null where there is no ``by``).
    """
    run = running(df, c, by)
    at = lambda place: F.max(F.when((F.col("before") <= place) & (F.col("before") + F.col("k") > place), F.col("value").cast("double")))
    spot = lambda q: F.lit(float(q)) * (F.col("n") - 1)
    ends = [(at(F.floor(spot(q))), at(F.ceil(spot(q))), F.max(spot(q) - F.floor(spot(q)))) for q in qs]
    cells = [x.alias(f"__{k}_{j}") for k, e in enumerate(ends) for j, x in enumerate(e)]
    found = run.groupBy(*by).agg(*cells)
    mixed = [F.col(f"__{k}_0") + F.col(f"__{k}_2") * (F.col(f"__{k}_1") - F.col(f"__{k}_0")) for k in range(len(qs))]
    return found.select(*by, F.when(F.col("__0_0").isNotNull(), F.array(*mixed)).alias(name))


def quantiles_of(df: DataFrame, cols: Sequence[str], qs: Sequence[float], by: Sequence[str] = (), name: str = "q") -> DataFrame:
    """column, by and ``name``: the exact quantiles of many numeric columns from one running count over (column, group, value).

    Nulls and non-finite numbers are left out; a column of a group without values has no row.
    """
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols))
    long = df.select(*by, F.explode(cells).alias("__x")).select(*by, "__x.column", "__x.value").where("value is not null and not isnan(value) and abs(value) < double('infinity')")
    return quantiles(long, "value", qs, ["column", *by], name)


def quantile_higher(df: DataFrame, c: str, q: float, by: Sequence[str] = ()) -> DataFrame:
    """Element ceil(q (n - 1)) counted from 0; q <= 0: smallest, q >= 1: largest."""
    q = min(max(q, 0.0), 1.0)
    return order_stat(df, c, F.ceil(F.round(F.lit(q) * (F.col("n") - 1), 9)) + 1, by)


def quantile_conformal(df: DataFrame, c: str, level: float, by: Sequence[str] = ()) -> DataFrame:
    """Element ceil((n + 1) level) counted from 1, within 1..n."""
    return order_stat(df, c, F.greatest(F.lit(1), F.least(F.col("n"), F.ceil(F.round((F.col("n") + 1) * F.lit(level), 9)))), by)


def average_rank(df: DataFrame, c: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Adds the average rank (ties share it); null has none."""
    ranks = running(df, c, by).select(*(F.col(b).alias(f"__b_{b}") for b in by), F.col("value").alias("__v"), (F.col("before") + (F.col("k") + 1) / 2).alias(name))
    same = [F.col(c) == F.col("__v"), *(F.col(b).eqNullSafe(F.col(f"__b_{b}")) for b in by)]
    return df.join(ranks, reduce(lambda a, b: a & b, same), "left").drop("__v", *(f"__b_{b}" for b in by))


def keep_best(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key: the first by ``order`` (make it a total order)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def top_n(df: DataFrame, order: Sequence[Column], n: int, by: Sequence[str] = ()) -> DataFrame:
    if not by:
        return df.orderBy(*order).limit(n)
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= n).drop("__k")


def bin_edges(df: DataFrame, c: str, n: int, by: Sequence[str] = ()) -> DataFrame:
    """edges: distinct exact quantiles at 0, 1/n .. 1."""
    found = quantiles(df, c, [k / n for k in range(n + 1)], by, "edges")
    return found.withColumn("edges", F.coalesce(F.array_distinct("edges"), F.array().cast("array<double>")))


def qcut(df: DataFrame, c: str, n: int, name: str = "bin", by: Sequence[str] = ()) -> DataFrame:
    """Adds the quantile bin from 0 (closed on the right; the first also on the left); duplicate edges fall together."""
    edges = bin_edges(df, c, n, by)
    out = df.join(F.broadcast(edges), list(by)) if by else df.crossJoin(F.broadcast(edges))
    inner = F.slice("edges", F.lit(2), F.greatest(F.size("edges") - 2, F.lit(0)))
    return out.withColumn(name, F.when(F.col(c).isNotNull(), F.size(F.filter(inner, lambda e: e < F.col(c))))).drop("edges")


def error_cdf(df: DataFrame, error: str, thresholds: Sequence[float] = (0.5, 1.0, 1.5)) -> DataFrame:
    """error, n, cumulative share (percent) of rows with at most that error, whether it is a key threshold; by distinct error."""
    counts = value_counts(df, error)
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(F.col("value").alias("error"), "n", (100.0 * (F.col("before") + F.col("n")) / F.col("total")).alias("percent"), F.col("value").isin([float(t) for t in thresholds]).alias("is_key_threshold"))


def select_best(df: DataFrame, metric: str, stage: str, higher: bool, eps: float = 1e-12) -> DataFrame:
    """The row with the best metric; non-finite never wins; of values within eps the earliest stage."""
    from marlstone.functions.expr import finite

    good = df.where(finite(metric))
    best = good.agg((F.max(metric) if higher else F.min(metric)).alias("__best"))
    near = good.crossJoin(F.broadcast(best)).where(F.abs(F.col(metric) - F.col("__best")) <= eps).drop("__best")
    return near.orderBy(stage).limit(1)


def auto_grid(df: DataFrame, c: str, least: int = 20, default: Sequence[float] = (0.5, 1.0, 1.5)) -> DataFrame:
    """grid: distinct 10..90 % quantiles rounded half-even to 3 places; the default below ``least`` rows."""
    found = quantiles(df, c, [k / 10 for k in range(1, 10)]).crossJoin(F.broadcast(df.agg(F.count(c).alias("n"))))
    grid = F.array_distinct(F.transform("q", lambda x: F.bround(x, 3)))
    return found.select(F.when(F.col("n") >= least, grid).otherwise(F.array(*map(F.lit, default))).alias("grid"))


def sort_output(df: DataFrame, key: str, endpoint: str) -> DataFrame:
    """Rows in their final order: source row, then endpoint; nulls first. A global sort by ranges."""
    return df.orderBy(F.col(key).asc_nulls_first(), F.col(endpoint).asc_nulls_first())
