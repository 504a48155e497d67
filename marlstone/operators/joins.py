"""Joins: cross references, token mapping, membership flags, alignment checks, edge lookup, set operations."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.expr import split_tokens
from marlstone.operators.conformal import bin_of


def xref(keys: DataFrame, tables: Sequence[tuple[DataFrame, str]], select: Sequence[str]) -> DataFrame:
    """Rows reached from distinct keys through a chain of inner equi-joins; each (table, column to join on)."""
    out = keys.distinct()
    for table, on in tables:
        out = out.join(table, on)
    return out.select(*select).distinct()


def map_tokens(df: DataFrame, key: str, col: str, mapping: DataFrame, token: str, value: str) -> DataFrame:
    """key, mapped: the distinct ids of all tokens of a row's field, in order, joined by ``|`` ('' if none)."""
    tokens = df.select(key, F.explode_outer(split_tokens(col)).alias("__t"))
    ids = tokens.join(mapping.select(F.col(token).alias("__t"), F.col(value).cast("string").alias("__v")).distinct(), "__t", "left")
    return ids.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("__v")), "|").alias("mapped"))


def _once(df: DataFrame, key: str, side: str) -> DataFrame:
    """df; a key that occurs twice is an error when it is met. Null keys are let through."""
    many = df.withColumn("__n", F.count("*").over(Window.partitionBy(key)))
    told = F.raise_error(F.concat(F.lit(f"a key of the {side} is not unique: "), F.col(key).cast("string"))).cast(df.schema[key].dataType)
    return many.withColumn(key, F.when((F.col("__n") == 1) | F.col(key).isNull(), F.col(key)).otherwise(told)).drop("__n")


def attach_predictions(labels: DataFrame, preds: DataFrame, key: str) -> DataFrame:
    """Inner join on the key; columns that both have come from ``labels``. A key that occurs twice on a side is an error."""
    return _once(labels, key, "labels").join(_once(preds.select(key, *(c for c in preds.columns if c not in labels.columns)), key, "predictions"), key)


def check_keys(labels: DataFrame, preds: DataFrame, key: str) -> DataFrame:
    """n_labels, n_preds, n_duplicates, n_missing, n_extra: whether predictions cover each label once."""
    a = labels.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("a"))
    b = preds.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("b"))
    return a.join(b, "k", "full").agg(
        F.coalesce(F.sum("a"), F.lit(0)).alias("n_labels"), F.coalesce(F.sum("b"), F.lit(0)).alias("n_preds"), F.count_if((F.col("a") > 1) | (F.col("b") > 1)).alias("n_duplicates"), F.count_if(F.col("b").isNull()).alias("n_missing"), F.count_if(F.col("a").isNull()).alias("n_extra")
    )


def seen_flag(df: DataFrame, ref: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Adds whether the row's keys occur in ``ref``."""
    marks = ref.select(*keys).distinct().withColumn("__seen", F.lit(True))
    return df.join(marks, list(keys), "left").withColumn(name, F.coalesce("__seen", F.lit(False))).drop("__seen")


def attach_dimension(df: DataFrame, dim: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Adds the columns of ``defaults`` from the dimension, or the default where they are missing or null.

    Of several rows of a key the smallest (by these columns, in order, nulls first) counts.
    """
    rows = dim.groupBy(key).agg(F.min(F.struct(*defaults)).alias("__d")).select(key, *(F.col(f"__d.{c}").alias(c) for c in defaults))
    return df.join(rows, key, "left").fillna(defaults)


def check_alignment(a: DataFrame, b: DataFrame, key: str, col: str, tolerance: float) -> DataFrame:
    """n_both, n_only_a, n_only_b, worst (largest difference), ok."""
    both = a.select(F.col(key).alias("ka"), F.col(col).alias("va")).join(b.select(F.col(key).alias("kb"), F.col(col).alias("vb")), F.col("ka") == F.col("kb"), "full")
    s = both.agg(F.count_if(F.col("ka").isNotNull() & F.col("kb").isNotNull()).alias("n_both"), F.count_if(F.col("kb").isNull()).alias("n_only_a"), F.count_if(F.col("ka").isNull()).alias("n_only_b"), F.max(F.abs(F.col("va") - F.col("vb"))).alias("worst"))
    return s.withColumn("ok", (F.col("n_only_a") == 0) & (F.col("n_only_b") == 0) & (F.coalesce("worst", F.lit(0.0)) <= tolerance))


def select_by_key(df: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the wanted keys, equal duplicates once; duplicates that disagree are an error."""
    rows = df.join(wanted.select(*keys).distinct(), list(keys), "left_semi").distinct()
    counts = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    return rows.join(counts, list(keys)).withColumn("__n", F.when(F.col("__n") > 1, F.raise_error(F.lit("conflicting duplicates"))).otherwise(F.col("__n"))).where("__n = 1").drop("__n")


def map_distinct(df: DataFrame, col: str, fn: Callable[[Column], Column], name: str) -> DataFrame:
    """Adds fn(col), computed once for each distinct value."""
    values = df.select(col).where(F.col(col).isNotNull()).distinct()
    return df.join(values.withColumn(name, fn(F.col(col))), col, "left")


def edge_lookup(df: DataFrame, col: str, edges: Sequence[float], name: str = "bin") -> DataFrame:
    return df.withColumn(name, F.when(F.col(col).isNotNull(), bin_of(F.col(col), F.array(*map(F.lit, edges)))))


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def overlap(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def outside(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of a whose keys b lacks (null keys are equal to none and stay)."""
    return a.join(b.select(*keys).distinct(), list(keys), "left_anti")


def distinct_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys).distinct()
