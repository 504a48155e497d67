"""Filters as ordered rules: a row's first failing rule is its reason."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.expr import finite

Rule = tuple[str, Column]


def any_present(cols: Sequence[str]) -> Column:
    return F.coalesce(*(F.col(c).isNotNull() & F.lit(True) for c in cols)) if len(cols) == 1 else F.array_contains(F.array(*(F.col(c).isNotNull() for c in cols)), True)


def nonempty(cols: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False))
    return out


def in_range_or_null(ranges: dict[str, tuple[float, float]]) -> Column:
    """All columns null or inside their closed range."""
    out = F.lit(True)
    for c, (lo, hi) in ranges.items():
        out = out & (F.col(c).isNull() | F.col(c).between(lo, hi))
    return out


def tag_rules(df: DataFrame, rules: Sequence[Rule], name: str = "filter_reason") -> DataFrame:
    """Adds the name of the first rule whose condition is not true (null counts as failed); null if all hold."""
    reason = F.lit(None).cast("string")
    for rule, ok in reversed(rules):
        reason = F.when(~F.coalesce(ok, F.lit(False)), F.lit(rule)).otherwise(reason)
    return df.withColumn(name, reason)


def with_rejects(df: DataFrame, rules: Sequence[Rule], keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows that pass all rules, rejected keys with reason, each once)."""
    tagged = tag_rules(df, rules)
    return tagged.where("filter_reason is null").drop("filter_reason"), tagged.where("filter_reason is not null").select(*keys, "filter_reason").dropDuplicates()


def rule_counts(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """rule, step, before, removed, after: what each rule in turn meets and removes, from one count by reason."""
    steps = df.sparkSession.createDataFrame([(i, n) for i, (n, _) in enumerate(rules)], "step int, rule string")
    counts = tag_rules(df, rules).groupBy(F.col("filter_reason").alias("rule")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    joined = steps.join(counts, "rule", "left").select("step", "rule", F.coalesce("n", F.lit(0)).alias("removed"))
    earlier = joined.select(F.col("step").alias("s"), F.col("removed").alias("r"))
    gone = joined.join(F.broadcast(earlier), F.col("s") < F.col("step"), "left").groupBy("step", "rule", "removed").agg(F.coalesce(F.sum("r"), F.lit(0)).alias("gone"))
    out = gone.crossJoin(F.broadcast(total))  # one row a rule, one total
    return out.select("step", "rule", (F.col("total") - F.col("gone")).alias("before"), "removed", (F.col("total") - F.col("gone") - F.col("removed")).alias("after"))


def model_input(df: DataFrame, target: str, compound: str, label: str, weight: str) -> DataFrame:
    """Rows with a target, a compound and a finite label; a weight that is null, not finite or not positive becomes 1."""
    kept = df.where(nonempty([target]) & F.col(compound).isNotNull() & finite(label))
    return kept.withColumn(weight, F.when(finite(weight) & (F.col(weight) > 0), F.col(weight)).otherwise(F.lit(1.0)))


def accept(bound: str, most: float) -> Column:
    return F.coalesce(finite(bound) & (F.col(bound) <= most), F.lit(False))
