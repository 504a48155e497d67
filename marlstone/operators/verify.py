"""Checks of results: expected metrics and counts, cell-wise comparison, conformal coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assert_metrics(found: DataFrame, expected: DataFrame, keys: Sequence[str], value: str, tolerance: float = 1e-10) -> DataFrame:
    """keys, found, expected, difference, ok; a metric that one side lacks is not ok."""
    a = found.select(*keys, F.col(value).cast("double").alias("found"))
    b = expected.select(*keys, F.col(value).cast("double").alias("expected"))
    d = F.abs(F.col("found") - F.col("expected"))
    return a.join(b, list(keys), "full").withColumns({"difference": d, "ok": F.coalesce(d <= tolerance, F.lit(False))})


def assert_counts(df: DataFrame, by: str, expected: DataFrame) -> DataFrame:
    """by, n, expected, ok; expected has columns ``by`` and n."""
    found = df.groupBy(by).agg(F.count("*").alias("n"))
    both = found.join(expected.select(by, F.col("n").alias("expected")), by, "full")
    return both.withColumn("ok", F.coalesce(F.col("n") == F.col("expected"), F.lit(False)))


def compare_tables(a: DataFrame, b: DataFrame, keys: Sequence[str], tolerance: float = 1e-10) -> DataFrame:
    """column, n_equal, n_different, n_one_sided: numbers within tolerance, anything else equal; both null is equal."""
    cols = [c for c in a.columns if c not in keys]
    both = a.withColumn("__a", F.lit(1)).join(b.select(*keys, *(F.col(c).alias(f"__{c}") for c in cols), F.lit(1).alias("__b")), list(keys), "full")
    cells = []
    for c in cols:
        same = F.col(c).eqNullSafe(F.col(f"__{c}"))
        if dict(a.dtypes)[c] in ("double", "float"):
            same = same | F.coalesce(F.abs(F.col(c) - F.col(f"__{c}")) <= tolerance, F.lit(False))
        cells.append(F.struct(F.lit(c).alias("column"), (F.col("__a").isNull() | F.col("__b").isNull()).alias("one"), same.alias("same")))
    rows = both.select(F.inline(F.array(*cells)))
    return rows.groupBy("column").agg(F.count_if(~F.col("one") & F.col("same")).alias("n_equal"), F.count_if(~F.col("one") & ~F.col("same")).alias("n_different"), F.count_if("one").alias("n_one_sided"))


def verify_conformal(preds: DataFrame, membership: DataFrame, table: DataFrame, key: str, endpoint: str, y: str, p: str, half: str) -> DataFrame:
    """n_members, n_duplicates, n_endpoint_differs, n_covered, covered_ok: the stored counts (column covered) rebuilt."""
    joined = preds.join(membership.select(key, F.col(endpoint).alias("__e"), "subset"), key)
    dup = membership.groupBy(key).agg(F.count("*").alias("n")).agg(F.count("*").alias("n_members"), F.count_if(F.col("n") > 1).alias("n_duplicates"))
    found = joined.agg(F.count_if(~F.col(endpoint).eqNullSafe(F.col("__e"))).alias("n_endpoint_differs"), F.count_if((F.col("subset") == "evaluation") & (F.abs(F.col(y) - F.col(p)) <= F.col(half))).alias("n_covered"))
    stored = table.agg(F.sum("covered").alias("__stored"))
    return dup.crossJoin(found).crossJoin(stored).withColumn("covered_ok", F.col("n_covered") == F.col("__stored")).drop("__stored")  # one row each
