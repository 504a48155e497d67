"""Regression as Spark ML jobs: features, fits on training rows only, staged selection, scoring, importance."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import CountVectorizer, Normalizer, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions.expr import apply_affine, finite, prob_ge, residual_target, sigma_from_log
from marlstone.functions.shared import written
from marlstone.operators.gram import gram_sums, predict_linear, ridge_by_group, ridge_folds
from marlstone.operators.metrics import abs_error_shares, concordance, regression_metrics, rm2
from marlstone.operators.order import prefix_sum, select_best
from marlstone.operators.rules import accept
from marlstone.operators.split import hash_key, train_rows


def text_features(df: DataFrame, text: str, numeric: Sequence[str] = (), max_features: int = 500, split: str = "split") -> PipelineModel:
    """Token counts of unit length beside numeric columns, in ``features``; the vocabulary is fitted on training rows."""
    steps = [RegexTokenizer(inputCol=text, outputCol="__tokens", pattern=r"\s+"), CountVectorizer(inputCol="__tokens", outputCol="__counts", vocabSize=max_features, minDF=2), Normalizer(inputCol="__counts", outputCol="__unit", p=2.0), VectorAssembler(inputCols=["__unit", *numeric], outputCol="features")]
    return Pipeline(stages=steps).fit(train_rows(df, split))


def assemble(df: DataFrame, cols: Sequence[str], name: str = "features", invalid: str = "skip") -> DataFrame:
    """Adds the vector of ``cols``; rows with a null or NaN among them are left out, or kept with NaN (invalid="keep")."""
    return VectorAssembler(inputCols=list(cols), outputCol=name, handleInvalid=invalid).transform(df)


def scale_target(df: DataFrame, y: str, split: str = "split") -> tuple[DataFrame, float, float]:
    """(df with y_scaled, mean, population sd of the training rows)."""
    mean, sd = train_rows(df, split).agg(F.avg(y), F.stddev_pop(y)).first()
    return df.withColumn("y_scaled", (F.col(y) - mean) / (sd or 1.0)), mean, sd or 1.0


def fit_ridge(df: DataFrame, y: str, weight: str, alpha: float = 1.0, split: str = "split"):
    """Ridge with the penalty alpha on the summed loss: sum of w (y - x b)^2 + alpha b^2.

    Spark's penalty stands beside the mean loss of a label of unit spread: so alpha is divided by the weights' sum and
    multiplied by the label's standard deviation.
    """
    train = train_rows(df, split)
    w, v = F.col(weight), F.col(y)
    total, spread = train.agg(F.sum(w), F.sqrt(F.greatest(F.lit(0.0), F.sum(w * v * v) / F.sum(w) - F.pow(F.sum(w * v) / F.sum(w), F.lit(2.0))))).first()
    return LinearRegression(labelCol=y, weightCol=weight, elasticNetParam=0.0, regParam=alpha / total * (spread or 1.0), standardization=False).fit(train)


def fit_elastic_net(df: DataFrame, y: str, weight: str, alpha: float = 1e-5, l1: float = 0.15, split: str = "split"):
    return LinearRegression(labelCol=y, weightCol=weight, elasticNetParam=l1, regParam=alpha).fit(train_rows(df, split))


#: Objectives of staged training by name: the history's column and whether more is better.
OBJECTIVES = {"rmse": ("rmse", False), "mse": ("mse", False), "ae_q": ("ae_q", False), "r2": ("r2", True), "ci": ("ci", True), "r2m": ("rm2_mean", True), "r2m_raw": ("rm2", True)}
ALIASES = {"l2": "mse", "ae_q99": "ae_q", "aeq": "ae_q", "r^2": "r2", "cindex": "ci", "concordance": "ci", "r2m_bar": "r2m", "r2mbar": "r2m"}


def tree_arrays(model: GBTRegressionModel) -> list[tuple[np.ndarray, ...]]:
    """(feature, threshold, left, right, value) by node of each tree, the root first; feature -1 is a leaf; values are weighted."""
    out = []
    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        rows: list[list[float]] = []

        def visit(node, rows=rows, weight=weight) -> int:
            at = len(rows)
            rows.append([-1, 0.0, 0, 0, node.prediction() * weight])
            if node.getClass().getSimpleName() == "InternalNode":
                test = node.split()
                if test.getClass().getSimpleName() != "ContinuousSplit":
                    raise ValueError("trees with categorical splits are not read")
                rows[at][:4] = [test.featureIndex(), test.threshold(), visit(node.leftChild()), visit(node.rightChild())]
            return at

        visit(tree._java_obj.rootNode())
        columns = list(zip(*rows, strict=True))
        out.append(tuple(np.array(c, k) for c, k in zip(columns, (np.int64, np.float64, np.int64, np.int64, np.float64), strict=True)))
    return out


def staged_predictions(df: DataFrame, model: GBTRegressionModel, stages: Sequence[int], name: str = "staged") -> DataFrame:
    """Adds the array of the predictions of the first k trees, for each k of ``stages`` (ascending), in one scan of the rows."""
    trees, ends = tree_arrays(model), list(stages)
    keep = [c for c in df.columns if c not in (name, "__x")]
    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])
    carried = [c for c in keep if c != model.getFeaturesCol()]
    flat = T.StructType([*(df.schema[c] for c in carried), schema[name]])

    def run(batches):
        for batch in batches:
            x = batch.column(len(carried))
            rows = x.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1))
            total, out, done = np.zeros(len(rows)), np.zeros((len(rows), len(ends))), 0
            for k, end in enumerate(ends):
                for feature, threshold, left, right, value in trees[done:end]:
                    at = np.zeros(len(rows), np.int64)
                    inner = np.flatnonzero(feature[at] >= 0)
                    while len(inner):
                        node = at[inner]
                        at[inner] = np.where(rows[inner, feature[node]] <= threshold[node], left[node], right[node])
                        inner = inner[feature[at[inner]] >= 0]
                    total += value[at]
                out[:, k], done = total, end
            lists = pa.ListArray.from_arrays(np.arange(0, out.size + 1, max(1, len(ends)), dtype=np.int32), out.ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carried)], lists], names=flat.names)

    return df.select(*carried, vector_to_array(model.getFeaturesCol()).alias("__x")).mapInArrow(run, flat)


def stage_history(df: DataFrame, model: GBTRegressionModel, y: str, every: int = 1, q: float = 0.99, split: str = "split") -> DataFrame:
    """split, trees, n and the metrics that the objectives ask for (rmse, mse, ae_q, r2, ci, rm2, rm2_mean; pearson and mae
    too), of every ``every`` trees and of all of them, from one scan: rows x stages are judged together."""
    ends = sorted({*range(every, len(model.trees) + 1, every), len(model.trees)})
    rows = staged_predictions(df.where(F.col(split).isNotNull()).select(y, split, model.getFeaturesCol()), model, ends)
    rows = written(rows.select(y, split, F.explode(F.arrays_zip(F.array(*map(F.lit, ends)).alias("trees"), F.col("staged").alias("p"))).alias("s")).select(y, F.concat_ws("|", F.lpad(F.col("s.trees").cast("string"), 9, "0"), split).alias("stage"), F.col("s.p").alias("p")))
    out = regression_metrics(rows, y, "p", "stage")
    ae = abs_error_shares(rows, y, "p", by="stage", q=q)
    for part in (rm2(rows, y, "p", "stage").select("subset", "rm2", "rm2_mean"), concordance(rows, y, "p", "stage").select("subset", "ci"), ae.select("subset", F.col(ae.columns[-1]).alias("ae_q"))):
        out = out.join(part, "subset", "left")
    out = out.where("subset <> 'overall'").withColumns({split: F.substring_index("subset", "|", -1), "trees": F.substring_index("subset", "|", 1).cast("int")})
    return out.select(split, "trees", "n", "rmse", "mse", "mae", "ae_q", "r2", "pearson", "ci", "rm2", "rm2_mean")


def first_trees(model: GBTRegressionModel, k: int) -> GBTRegressionModel:
    """The model of the first k trees, without another fit."""
    from pyspark import SparkContext

    context = SparkContext._active_spark_context
    jvm, gateway, old = context._jvm, context._gateway, model._java_obj
    trees = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, k)
    weights = gateway.new_array(jvm.double, k)
    for i, (tree, weight) in enumerate(zip(model.trees[:k], model.treeWeights[:k], strict=True)):
        trees[i], weights[i] = tree._java_obj, float(weight)
    made = jvm.org.apache.spark.ml.regression.GBTRegressionModel(old.uid(), trees, weights)
    made.setFeaturesCol(old.getFeaturesCol())
    made.setPredictionCol(old.getPredictionCol())
    out = GBTRegressionModel(made)
    out._resetUid(old.uid())
    return out


def fit_boosted(df: DataFrame, y: str, weight: str, stages: int = 10, every: int = 2, depth: int = 4, seed: int = 7, split: str = "split", objective: str = "rmse", q: float = 0.99) -> tuple[GBTRegressionModel, DataFrame]:
    """(model of the best stage, stage history): boosted trees fitted once; every stage is judged on the rows whose split is
    "valid" by one of OBJECTIVES (an unknown name is an error); of equal stages the earliest wins."""
    name = objective.strip().lower().replace("-", "_")
    column, higher = OBJECTIVES[ALIASES.get(name, name)]
    model = GBTRegressor(labelCol=y, weightCol=weight, maxIter=stages, maxDepth=depth, stepSize=0.2, seed=seed).fit(train_rows(df, split))
    history = written(stage_history(df, model, y, every, q, split))
    best = select_best(history.where(F.col(split) == "valid"), column, "trees", higher).first()
    return (first_trees(model, best.trees) if best else model), history


def fit_sigma(df: DataFrame, y: str, p: str, features: str = "features", kind: str = "squared", least: int = 200, seed: int = 7):
    """A regressor of the log residual on features and prediction; below ``least`` rows an error.

    A fifth of the rows, by a hash of label and prediction, is held out; trees are added until its loss stops falling.
    """
    rows = df.where(finite(y, p))
    if rows.limit(least).count() < least:
        raise ValueError(f"the sigma model needs {least} rows")
    rows = VectorAssembler(inputCols=[features, p], outputCol="__sigma_features").transform(rows.withColumn("__target", residual_target(y, p, kind)))
    rows = rows.withColumn("__held", F.pmod(F.xxhash64(y, p, F.lit(seed)), F.lit(5)) == 0)
    return GBTRegressor(labelCol="__target", featuresCol="__sigma_features", predictionCol="__log_sigma", validationIndicatorCol="__held", validationTol=0.01, maxIter=20, maxDepth=3, seed=seed).fit(rows)


def predict_sigma(df: DataFrame, model, p: str, features: str = "features", kind: str = "squared") -> DataFrame:
    out = model.transform(VectorAssembler(inputCols=[features, p], outputCol="__sigma_features").transform(df))
    return out.withColumn("sigma", sigma_from_log("__log_sigma", kind == "squared")).drop("__sigma_features", "__log_sigma")


def fit_by_endpoint(df: DataFrame, endpoint: str, features: Sequence[str], y: str, weight: str, alpha: float = 1.0, split: str = "split") -> DataFrame:
    """endpoint, n, intercept, coefficients: a ridge for each endpoint on its training rows, all from one pass."""
    return ridge_by_group(gram_sums(train_rows(df, split), features, y, weight, [endpoint]), [endpoint], alpha)


def cross_validate(df: DataFrame, fold: str, features: Sequence[str], y: str, weight: str, alpha: float = 1.0, by: Sequence[str] = ()) -> DataFrame:
    """fold, n, rmse, mae, r2 (and more: see ``regression_metrics``) of a ridge fitted on the other folds.

    All fits come from the sums of one pass, each fold's own taken off the total; ``by``: a model for each group. A row whose
    fold has no fit is not judged.
    """
    fits = written(ridge_folds(gram_sums(df, features, y, weight, [*by, fold]), fold, by, alpha))
    scored = predict_linear(df, fits, features, [*by, fold])
    out = regression_metrics(scored, y, "prediction", fold).where("subset <> 'overall'")
    return out.withColumn(fold, F.col("subset").cast(df.schema[fold].dataType)).select(fold, "n", "rmse", "mae", "r2")


def score(df: DataFrame, model, calibration: tuple[float, float], q_scale: float, threshold: float, err_max: float, mean: float = 0.0, sd: float = 1.0) -> DataFrame:
    """Prediction, bounds, acceptance and probability of each row; null where a feature is NaN (see ``assemble``)."""
    out = model.transform(df)
    out = out.withColumn("prediction", F.when(finite("prediction"), F.col("prediction")))
    a, b = calibration
    out = out.withColumn("y_pred", apply_affine(F.col("prediction") * sd + mean, a, b)).withColumn("err_bound", F.col("sigma") * q_scale)
    return out.withColumns({"pred_lo": F.col("y_pred") - F.col("err_bound"), "pred_hi": F.col("y_pred") + F.col("err_bound"), "accepted": accept("err_bound", err_max), "prob_strong": F.when(F.col("y_pred").isNotNull(), prob_ge("y_pred", "sigma", threshold))}).drop("prediction")


def permuted_errors(test: DataFrame, model, groups: dict[str, Sequence[str]], y: str, key: str, repeats: int, seed: int = 5) -> DataFrame:
    """group, repeat, mse: squared error with a group's columns taken from other rows; group null is the error as it is.

    The rows are ranked once by a hash of ``key``. In repeat r of group g the row of rank i takes the columns of the row of
    rank (a i + b) mod n, a permutation as a and n have no common divisor. All repeats of all groups are one frame: one join
    by rank and one pass of the model.
    """
    cols = [c for g in groups.values() for c in g]
    ranked = prefix_sum(test.select(key, y, *cols).withColumns({"__h": hash_key(key, seed), "__1": F.lit(1)}), ["__h", key], ["__1"])
    ranked = written(ranked.select(F.col("before___1").alias("__r"), F.col(y).cast("double").alias("__y"), *cols))
    n = ranked.count()
    plans = [(None, 0, 1, 0), *((g, r, *permutation(n, seed, k, r)) for r in range(repeats) for k, g in enumerate(groups))]
    cases = F.array(*(F.struct(F.lit(g).cast("string").alias("group"), F.lit(r).alias("repeat"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for g, r, a, b in plans))
    asked = ranked.select("*", F.explode(cases).alias("__c")).select("*", "__c.group", "__c.repeat", ((F.col("__c.a") * F.col("__r") + F.col("__c.b")) % max(n, 1)).alias("__d")).drop("__c", "__r")
    donors = ranked.select(F.col("__r").alias("__d"), *(F.col(c).alias(f"__d_{c}") for c in cols))
    mixed = asked.join(donors, "__d").select("group", "repeat", "__y", *(F.when(F.col("group") == g, F.col(f"__d_{c}")).otherwise(F.col(c)).alias(c) for g, members in groups.items() for c in members))
    e = F.col("prediction") - F.col("__y")
    return model.transform(assemble(mixed, cols)).groupBy("group", "repeat").agg(F.avg(e * e).alias("mse"))


def permutation(n: int, seed: int, group: int, repeat: int) -> tuple[int, int]:
    """(a, b) of one repeat of one group; a and n have no common divisor, and a times n stays below 2**62."""
    rng = np.random.default_rng([seed, group, repeat])
    a = int(rng.integers(1, max(2, min(n, 2**62 // max(n, 1)))))
    while math.gcd(a, max(n, 1)) != 1:
        a += 1
    return a, int(rng.integers(0, max(n, 1)))


def grouped_importance(df: DataFrame, groups: dict[str, Sequence[str]], y: str, key: str, repeats: int = 3, seed: int = 5) -> DataFrame:
    """group, importance, spread, share: rise of the held-out squared error when a group's columns are permuted together.

    Trees are fitted on four fifths by hash, the fifth is permuted (see ``permuted_errors``). importance: mean rise over the
    repeats; spread: its population standard deviation; share: of the rises above 0. A column stands in one group.
    """
    cols = [c for g in groups.values() for c in g]
    rows = df.withColumn("__test", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(5)) == 0)
    # Read again by every tree. Filtered after it is written: pushed below the columns, the filter works each of them out several times.
    rows = written(rows.select(key, y, *cols, "__test")).where(finite(y, *cols))
    model = GBTRegressor(labelCol=y, maxIter=10, maxDepth=4, seed=seed).fit(assemble(rows.where("not __test"), cols))
    errors = written(permuted_errors(rows.where("__test"), model, groups, y, key, repeats, seed))
    base = errors.where("group is null").select(F.col("mse").alias("base"))  # one row
    means = errors.where("group is not null").crossJoin(F.broadcast(base)).groupBy("group").agg(F.avg(F.col("mse") - F.col("base")).alias("importance"), F.stddev_pop(F.col("mse") - F.col("base")).alias("spread"))
    return means.withColumn("share", F.try_divide(F.greatest(F.col("importance"), F.lit(0.0)), F.sum(F.greatest(F.col("importance"), F.lit(0.0))).over(Window.partitionBy(F.lit(1)))))  # one row a group


def save_bundle(model, calibration: DataFrame, path: str) -> None:
    model.write().overwrite().save(f"{path}/model")
    calibration.write.mode("overwrite").parquet(f"{path}/calibration")


def load_bundle(spark, path: str, kind):
    return kind.load(f"{path}/model"), spark.read.parquet(f"{path}/calibration")


def compare_runs(df: DataFrame, run: str, metric: str, value: str, a: str, b: str) -> DataFrame:
    """metric, a, b and gain of run b over run a."""
    from marlstone.functions.expr import gain

    wide = df.groupBy(metric).agg(F.max(F.when(F.col(run) == a, F.col(value))).alias("a"), F.max(F.when(F.col(run) == b, F.col(value))).alias("b"))
    return wide.withColumn("gain", gain(metric, "a", "b"))
