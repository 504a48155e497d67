"""Leakage-safe splits by portable hashes, samples, training weights. Order inside strata is md5(key:seed), so a split
depends on neither partitioning nor row order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.order import prefix_sum, qcut, quantiles, rank_within


def hash_key(key: str | Sequence[str], seed: int) -> Column:
    cols = [key] if isinstance(key, str) else list(key)
    return F.md5(F.concat_ws(":", *(F.col(c).cast("string") for c in cols), F.lit(str(seed))).cast("binary"))


def _ranked(df: DataFrame, key: str | Sequence[str], seed: int) -> DataFrame:
    """Adds __rank (0-based, by hash) and __n; no single-partition window."""
    keyed = df.withColumn("__h", hash_key(key, seed)).withColumn("__one", F.lit(1))
    total = df.agg(F.count("*").alias("__n"))
    order = ["__h", *([key] if isinstance(key, str) else key)]
    return prefix_sum(keyed, order, ["__one"]).withColumnRenamed("before___one", "__rank").crossJoin(F.broadcast(total)).drop("__h", "__one")


def random_split(df: DataFrame, key: str, fraction: float, seed: int, names=("valid", "train")) -> DataFrame:
    """Adds ``split``: the first ceil(n fraction) rows by hash are held out."""
    return _ranked(df, key, seed).withColumn("split", F.when(F.col("__rank") < F.ceil(F.round(F.col("__n") * fraction, 9)), names[0]).otherwise(names[1])).drop("__rank", "__n")


def group_columns(mode: str, compound: str, protein: str) -> list[str]:
    """Columns of the group by mode: compound, protein or pair (random has none)."""
    return {"random": [], "compound": [compound], "protein": [protein], "pair": [compound, protein]}[mode]


def _medians(df: DataFrame, group: str, y: str) -> DataFrame:
    """group, __m: its median, null if it has no value."""
    return df.select(group).distinct().join(quantiles(df, y, [0.5], [group]).select(group, F.col("q")[0].alias("__m")), group, "left")


def group_stratified_split(df: DataFrame, group: str, y: str, fraction: float, seed: int, bins: int = 5) -> DataFrame:
    """Adds ``split`` by whole groups: in each quantile bin of the groups' medians round(m fraction), at least 1, are
    held out; then trimmed or topped up by hash to round(groups fraction) groups."""
    groups = _medians(df, group, y)
    binned = qcut(groups, "__m", bins, "__bin").withColumn("__h", hash_key(group, seed))
    sizes = binned.groupBy("__bin").agg(F.count("*").alias("__size"))
    drawn = rank_within(binned, "__bin", ["__h", group], "__k").join(F.broadcast(sizes), "__bin").withColumn("__in", F.col("__k") <= F.greatest(F.lit(1), F.bround(F.col("__size") * fraction).cast("int")))
    want = drawn.agg(F.bround(F.count("*") * F.lit(fraction)).cast("int").alias("__want"))
    ordered = prefix_sum(drawn.select(group, "__in", "__h", F.lit(1).alias("one"), F.when(F.col("__in"), 0).otherwise(1).alias("last")), ["last", "__h", group], ["one"])
    chosen = ordered.crossJoin(F.broadcast(want)).select(group, F.when(F.col("before_one") < F.col("__want"), "valid").otherwise("train").alias("split"))
    return df.join(chosen, group)


def group_kfold(df: DataFrame, group: str, y: str, k: int, seed: int, bins: int = 5) -> DataFrame:
    """Adds ``fold`` 0..k-1 by whole groups, dealt in turn by hash within each bin of the groups' medians."""
    groups = _medians(df, group, y)
    binned = qcut(groups, "__m", bins, "__bin").withColumn("__h", hash_key(group, seed))
    ranked = rank_within(binned, "__bin", ["__h", group], "__k")
    return df.join(ranked.select(group, ((F.col("__k") - 1) % k).cast("int").alias("fold")), group)


def stratified_fraction(df: DataFrame, key: str, endpoint: str, y: str, fraction: float, seed: int, bins: int = 10) -> DataFrame:
    """Rows of a nested subset: strata are endpoint and response bin (the endpoint alone below two rows), quotas by
    largest remainder so that floor(n fraction) rows are drawn."""
    binned = qcut(df, y, bins, "__bin", [endpoint])
    sizes = binned.groupBy(endpoint, "__bin").agg(F.count("*").alias("__m"))
    binned = binned.join(F.broadcast(sizes), [endpoint, "__bin"]).withColumn("__s", F.when(F.col("__m") < 2, F.concat(F.col(endpoint), F.lit(":all"))).otherwise(F.concat_ws(":", endpoint, "__bin")))
    strata = binned.groupBy("__s").agg(F.count("*").alias("n")).withColumn("q", F.col("n") * fraction)
    total = strata.agg(F.floor(F.round(F.sum("n") * F.lit(fraction), 9)).alias("want"), F.sum(F.floor("q")).alias("have"))
    rest = Window.orderBy(F.desc(F.round(F.col("q") - F.floor("q"), 9)), "__s")  # one row a stratum
    quotas = strata.crossJoin(F.broadcast(total)).withColumn("quota", F.floor("q") + F.when(F.row_number().over(rest) <= F.col("want") - F.col("have"), 1).otherwise(0))
    ranked = rank_within(binned.withColumn("__h", hash_key(key, seed)), "__s", ["__h", key], "__k")
    drawn = ranked.join(F.broadcast(quotas.select("__s", "quota")), "__s")
    return drawn.where(F.col("__k") <= F.col("quota")).select(*df.columns)


def calibration_split(df: DataFrame, key: str, endpoint: str, y: str, fraction: float, seed: int, bins: int = 10) -> DataFrame:
    """Adds ``subset`` calibration or evaluation, stratified by endpoint and decile."""
    cal = stratified_fraction(df, key, endpoint, y, fraction, seed, bins).select(F.col(key).alias("__k"))
    return df.join(cal, F.col(key) == F.col("__k"), "left").withColumn("subset", F.when(F.col("__k").isNotNull(), "calibration").otherwise("evaluation")).drop("__k")


def capped_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    return df.orderBy(hash_key(key, seed), key).limit(n)


def check_split(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """n_rows, n_keys, n_overlap (keys in more than one part), n_unassigned."""
    keys = df.groupBy(key).agg(F.count_distinct(F.col(split)).alias("parts"), F.count("*").alias("n"), F.count_if(F.col(split).isNull()).alias("none"))
    return keys.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_keys"), F.count_if(F.col("parts") > 1).alias("n_overlap"), F.sum("none").alias("n_unassigned"))


def restrict(df: DataFrame, endpoint: str, name: str) -> DataFrame:
    """The rows of one endpoint, with the split that they have in the whole table."""
    return df.where(F.col(endpoint) == name)


def membership(df: DataFrame, key: str, endpoint: str, subset: str = "subset") -> DataFrame:
    """key, endpoint, subset of every row that is in a subset: what another run needs to take the same rows."""
    return df.where(F.col(subset).isNotNull()).select(key, endpoint, subset)


def check_nested(small: DataFrame, large: DataFrame, key: str) -> DataFrame:
    """n_small, n_large, n_outside (keys of the smaller sample that the larger lacks) and ok."""
    outside = small.select(key).distinct().join(large.select(key), key, "left_anti").agg(F.count("*").alias("n_outside"))
    sizes = small.agg(F.count("*").alias("n_small")).crossJoin(F.broadcast(large.agg(F.count("*").alias("n_large"))))
    return sizes.crossJoin(F.broadcast(outside)).withColumn("ok", F.col("n_outside") == 0)


def fingerprint(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """n and an order-free digest of the rows' content; equal tables give equal digests however they are partitioned."""
    h = F.xxhash64(*cols)
    return df.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("sum_hash"), F.bit_xor(h).alias("xor_hash"))


def balance_weights(df: DataFrame, y: str, bins: int, power: float = 1.0, cap: float | None = None, name: str = "balance") -> DataFrame:
    """Adds inverse-frequency weights by quantile bin, to a power, capped before they are scaled to mean 1."""
    binned = qcut(df, y, bins, "__bin")
    counts = binned.groupBy("__bin").agg(F.count("*").alias("__c"))
    raw = F.pow(1.0 / F.col("__c"), F.lit(power))
    rows = binned.join(F.broadcast(counts), "__bin").withColumn(name, F.least(raw, F.lit(cap)) if cap else raw)
    return rows.crossJoin(F.broadcast(rows.agg(F.avg(name).alias("__mean")))).withColumn(name, F.col(name) / F.col("__mean")).drop("__bin", "__c", "__mean")


def training_weights(df: DataFrame, y: str, w: str, gamma: float = 0.0, power: float = 1.0, name: str = "train_weight") -> DataFrame:
    """Adds weights: null 1, at least 1e-6, times 1 + gamma |z|^power (population sd + 1e-8, |z| at most 3), mean 1."""
    spread = df.agg(F.avg(y).alias("__m"), (F.stddev_pop(y) + 1e-8).alias("__sd"))
    z = F.least(F.lit(3.0), F.abs((F.col(y) - F.col("__m")) / F.col("__sd")))
    rows = df.crossJoin(F.broadcast(spread)).withColumn(name, F.greatest(F.coalesce(F.col(w), F.lit(1.0)), F.lit(1e-6)) * (1 + gamma * F.pow(z, F.lit(power))))
    return rows.crossJoin(F.broadcast(rows.agg(F.avg(name).alias("__mean")))).withColumn(name, F.col(name) / F.col("__mean")).drop("__m", "__sd", "__mean")


def normalize_by_train(df: DataFrame, w: str, split: str = "split", train: str = "train") -> DataFrame:
    mean = df.where(F.col(split) == train).agg(F.avg(w).alias("__mean"))
    return df.crossJoin(F.broadcast(mean)).withColumn(w, F.col(w) / F.col("__mean")).drop("__mean")


def train_rows(df: DataFrame, split: str = "split", train: str = "train") -> DataFrame:
    """Only what a fit may see; a row without a split is an error."""
    checked = df.withColumn(split, F.when(F.col(split).isNull(), F.raise_error(F.lit("row without split"))).otherwise(F.col(split)))
    return checked.where(F.col(split) == train)
