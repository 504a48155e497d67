"""Reshaping: wide to long, one-hot, shares, flattening, imputation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators.order import quantiles
from marlstone.functions.expr import finite


def unpivot_endpoints(df: DataFrame, values: dict[str, str], weights: dict[str, str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """One row for each finite value: keep, endpoint, value, weight (1 where there is none).

    values: column of each endpoint name; weights: weight column of each endpoint name.
    """
    cells = F.array(*(F.struct(F.lit(n).alias("endpoint"), F.col(c).cast("double").alias("value"), (F.col(weights[n]) if weights and n in weights else F.lit(None)).cast("double").alias("weight")) for n, c in values.items()))
    rows = df.select(*keep, F.explode(cells).alias("x")).select(*keep, "x.*")
    return rows.where(finite("value")).withColumn("weight", F.when(finite("weight"), F.col("weight")).otherwise(F.lit(1.0)))


def one_hot(df: DataFrame, col: str, values: Sequence[str]) -> DataFrame:
    """A 0/1 column for each listed value; others (and null) give zeros only."""
    return df.withColumns({f"{col}_{v}": F.coalesce(F.col(col) == v, F.lit(False)).cast("int") for v in values})


def dummies(df: DataFrame, col: str, most: int = 1000) -> DataFrame:
    """A 0/1 column for each value that occurs, in order; more than ``most`` values are an error."""
    found = [r[0] for r in df.select(F.col(col).cast("string")).where(F.col(col).isNotNull()).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{col} has more than {most} values")
    return one_hot(df, col, sorted(found))


def pivot_share(df: DataFrame, rows: Sequence[str], column: str, value: str, names: Sequence[str]) -> DataFrame:
    return df.groupBy(*rows).pivot(column, list(names)).agg(F.first(value))


def flatten_metrics(df: DataFrame, subset: str, metric: str, value: str, names: Sequence[str]) -> DataFrame:
    """One wide row; columns ``subset_metric`` for the given names."""
    return df.withColumn("__n", F.concat_ws("_", subset, metric)).groupBy().pivot("__n", list(names)).agg(F.first(value))


def impute_median(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Null and non-finite values become the column's exact median, 0 if it has no finite value."""
    clean = df.select(*(F.when(finite(c), F.col(c).cast("double")).alias(c) for c in cols))
    for c in cols:
        df = df.crossJoin(F.broadcast(quantiles(clean, c, [0.5]).select(F.coalesce(F.get("q", F.lit(0)), F.lit(0.0)).alias(f"__{c}"))))
    return df.withColumns({c: F.when(finite(c), F.col(c).cast("double")).otherwise(F.col(f"__{c}")) for c in cols}).drop(*(f"__{c}" for c in cols))
