"""Properties and small cases: conventions, ties, nulls, empty tables, guards."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from marlstone.functions import expr as X
from marlstone.operators import agg, conformal, metrics, order, rules, split, text
from marlstone.sources import measurements
from marlstone.streaming.scoring import score_stream


def one(df):
    return df.first()


def brute_ci(rows):
    pairs = good = 0.0
    for (a, p), (b, q) in itertools.combinations(rows, 2):
        if a != b:
            pairs += 1
            good += 0.5 if p == q else float((p < q) == (a < b))
    return pairs, (good / pairs if pairs else None)


@pytest.mark.parametrize("rows", [[(1.0, 1.0), (2.0, 2.0), (3.0, 3.0)], [(1.0, 3.0), (2.0, 2.0), (3.0, 1.0)], [(1.0, 1.0), (1.0, 2.0), (2.0, 3.0)], [(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], [(1.0, 1.0), (2.0, 1.0), (2.0, 3.0), (3.0, 2.0)], [(1.0, 1.0), (1.0, 2.0)]])
def test_concordance_cases(spark, rows):
    got = one(metrics.concordance(spark.createDataFrame(rows, "y double, p double"), "y", "p"))
    pairs, ci = brute_ci(rows)
    assert got.n_pairs == pairs and (got.ci is None if ci is None else math.isclose(got.ci, ci))


def test_concordance_random_and_symmetric(spark):
    rng = random.Random(3)
    rows = [(round(rng.random(), 1), round(rng.random(), 1)) for _ in range(200)]
    df = spark.createDataFrame(rows, "y double, p double")
    got, mirrored = one(metrics.concordance(df, "y", "p")), one(metrics.concordance(df.withColumn("p", -F.col("p")), "y", "p"))
    assert math.isclose(got.ci, brute_ci(rows)[1]) and math.isclose(got.ci + mirrored.ci, 1.0)


@pytest.mark.parametrize("partitions", [1, 8, 64])
def test_prefix_sum_whatever_the_partitions(spark, partitions):
    df = spark.range(500).select(((F.col("id") * 7919) % 503).alias("k"), (F.col("id") % 5).alias("v"), F.lit("extra").alias("x"))
    run, rows = 0, sorted(order.prefix_sum(df, ["k"], ["v"], partitions).collect())
    for r in rows:
        assert r.before_v == run
        run += r.v


def test_equal_weights_give_the_lower_value(spark):
    df = spark.createDataFrame([(1, 10.0, 1.0), (1, 20.0, 1.0), (2, 5.0, 0.0), (3, None, 1.0)], "k int, v double, w double")
    assert {r.k: r.value for r in agg.weighted_percentile(df, ["k"], "v", "w").collect()} == {1: 10.0}


def test_qualifiers_units_and_text(spark):
    df = spark.createDataFrame([(">=1,200.5",), ("about 3",), ("~4",), ("<5e2",), ("nan",), ("",), (None,), ("7",)], "t string")
    got = [tuple(r.q) for r in df.select(X.parse_qualified("t").alias("q")).collect()]
    assert got == [(1200.5, 1.15, ">="), (3.0, 0.95, "≈"), (4.0, 0.95, "≈"), (500.0, 0.7, "<"), (None, None, "missing"), (None, None, "missing"), (None, None, "missing"), (7.0, 1.0, "=")]
    row = one(spark.createDataFrame([("AB|AB", 0.5, 123456.789)], "c string, x double, v double").select(X.collapse_equivalent("c").alias("c"), X.format_signed(F.lit("missing"), "x").alias("x"), X.format_signed(F.lit(">"), "v").alias("v")))
    assert (row.c, row.x, row.v) == ("AB", "=0.5", ">123457")


def test_probability_against_erfc(spark):
    df = spark.createDataFrame([(p / 4, 0.5) for p in range(-8, 9)] + [(1.0, None), (0.2, 0.0)], "p double, s double")
    for r in df.select("p", "s", X.prob_ge("p", "s", 0.75).alias("q")).collect():
        want = 0.5 * math.erfc((0.75 - r.p) / (r.s * math.sqrt(2))) if r.s else float(r.p >= 0.75)
        assert abs(r.q - want) < 2e-7


def test_quantile_conventions_differ(spark):
    df = spark.range(1, 11).select(F.col("id").cast("double").alias("x"))
    assert one(order.quantile_higher(df, "x", 0.5)).value == 6.0
    assert one(order.quantile_conformal(df, "x", 0.9)).value == 10.0
    assert one(order.quantile_conformal(df, "x", 0.5)).value == 6.0


def test_conformal_guards(spark):
    few = spark.range(40).select(F.col("id").cast("double").alias("y"), F.lit(1.0).alias("p"))
    with pytest.raises(Exception, match="50 rows"):
        conformal.fit_binned_conformal(few, "y", "p").collect()
    many = spark.range(60).select(F.col("id").cast("double").alias("y"), F.lit(1.0).alias("p"))
    assert conformal.fit_binned_conformal(many, "y", "p").count() == 1
    fit = one(conformal.fit_affine(spark.createDataFrame([(1.0, 2.0)], "y double, p double"), "y", "p"))
    assert (fit.a, fit.b) == (0.0, 1.0)


def test_single_class_and_constant_predictions(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 2.0)], "y double, p double")
    assert one(metrics.roc_auc(df, F.col("y") >= 0, "p")).auc is None
    got = one(metrics.regression_metrics(df, "y", "p"))
    assert got.r2 is None and got.pearson is None


def test_group_split_never_parts_a_group(spark):
    df = spark.range(300).select((F.col("id") % 40).alias("g"), F.col("id").alias("k"), (F.col("id") % 17).cast("double").alias("y"))
    out = split.group_stratified_split(df, "g", "y", 0.25, 1)
    assert out.groupBy("g").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    assert out.where("split = 'valid'").select("g").distinct().count() == 10
    again = split.group_stratified_split(df.repartition(7), "g", "y", 0.25, 1)
    assert sorted(map(tuple, out.select("k", "split").collect())) == sorted(map(tuple, again.select("k", "split").collect()))
    with pytest.raises(Exception, match="without split"):
        split.train_rows(df.withColumn("split", F.lit(None).cast("string"))).collect()


def test_fingerprint_is_free_of_order(spark):
    df = spark.range(100).withColumn("t", F.col("id").cast("string"))
    assert one(split.fingerprint(df, ["id", "t"])) == one(split.fingerprint(df.orderBy(F.desc("id")).repartition(5), ["id", "t"]))


def test_rules_take_the_first_reason(spark):
    df = spark.createDataFrame([(1, None, 5.0), (2, "x", 50.0), (3, "x", None)], "k int, t string, v double")
    kept, gone = rules.with_rejects(df, [("no_target", rules.nonempty(["t"])), ("range", rules.in_range_or_null({"v": (0, 10)}))], ["k"])
    assert [r.k for r in kept.collect()] == [3] and sorted(map(tuple, gone.collect())) == [(1, "no_target"), (2, "range")]


def test_sources(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("Name\tKi (nM)\tX\n a\t>5\t1\nb\t7\nc\t\"9\t3\n")
    good, bad = measurements.read_measurements(spark, str(tmp_path / "m.tsv"), {"Name": "name", "Ki (nM)": "ki"})
    assert sorted(map(tuple, good.collect())) == [(" a", ">5"), ("c", '"9')] and bad.count() == 1
    assert measurements.detect_columns(["Chain 2", "Chain 1", "x"], r"Chain (\d+)") == ["Chain 1", "Chain 2"]
    with pytest.raises(ValueError):
        measurements.resolve_columns(["a"], required=["target"])
    (tmp_path / "pKi.csv").write_text("SMILES,protein,Y,pred\na,b,1.5,2\na,b,x,2\n")
    got = measurements.read_predictions(spark, [str(tmp_path / "pKi.csv")]).collect()
    assert [(r.endpoint, r.y_true, r.y_pred) for r in got] == [("pKi", 1.5, 2.0)]


def test_stream_scores_each_row_once(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    schema = spark.range(1).schema
    spark.range(10).write.mode("append").parquet(src)
    run = lambda: score_stream(spark, src, schema, "id", lambda b: b.withColumn("y", F.col("id") * 2), out, mark)
    run()
    spark.range(5, 15).write.mode("append").parquet(src)
    run()
    got = spark.read.parquet(out)
    assert got.count() == 15 and got.select("id").distinct().count() == 15


def test_empty_tables(spark):
    none = spark.createDataFrame([], "k int, y double, p double, s double")
    assert metrics.regression_metrics(none, "y", "p").count() == 0
    assert agg.weighted_percentile(none, ["k"], "y", "p").count() == 0
    assert order.average_rank(none, "y", "r").count() == 0
    assert text.term_counts(spark.createDataFrame([], "k int, t string"), "k", text.char_ngrams("t", 2, 3)).count() == 0


def test_correlation_p(spark):
    """Against numbers of Student's t: r = 0.5 and 20 rows, 2 degrees in closed form (p = 1 - |r|), r = 0 and 1."""
    rows = spark.createDataFrame([(0.5, 20), (0.3, 4), (0.0, 10), (1.0, 5), (0.2, 2), (0.05, 100_000)], "r double, n long")
    got = [x[0] for x in rows.select(metrics.correlation_p("r", "n")).collect()]
    assert math.isclose(got[0], 0.02475, rel_tol=1e-3) and math.isclose(got[1], 0.7, rel_tol=1e-6) and got[2:5] == [1.0, 0.0, None] and got[5] < 1e-50


def test_concordance_with_heavy_ties_by_subset(spark):
    """A label and a prediction that fill buckets of their own; each subset against all pairs."""
    rng = random.Random(8)
    rows = [("a" if k % 3 else "b", 1.0 if rng.random() < 0.4 else round(rng.random() * 9, 2), 5.0 if rng.random() < 0.4 else round(rng.random() * 9, 1)) for k in range(900)]
    got = {r.subset: r for r in metrics.concordance(spark.createDataFrame(rows, "g string, y double, p double"), "y", "p", "g").collect()}
    for name, keep in (("overall", "ab"), ("a", "a"), ("b", "b")):
        pairs, ci = brute_ci([r[1:] for r in rows if r[0] in keep])
        assert got[name].n_pairs == pairs and math.isclose(got[name].ci, ci)


def test_replicates_with_null_keys_and_odd_numbers(spark):
    rows = [(None, 1, "k", 10.0, 1.0, "="), (None, 1, "k", 1000.0, 3.0, ">"), (None, 1, "k", 1000.0, 1.0, ">"), (2, None, "k", 5.0, 1.0, "<"), (2, None, "k", float("nan"), 1.0, "="), (3, 3, "k", 1.0, 1.0, "="), (3, 3, "k", 1e6, 1.0, "="), (3, 3, "d", 7.0, 1.0, "=")]
    df = spark.createDataFrame(rows, "c int, t int, endpoint string, value double, weight double, sign string")
    got = {(r.c, r.t): r for r in agg.aggregate_replicates(df, ["c", "t"]).collect()}
    assert set(got) == {(None, 1), (2, None)}  # 3, 3 conflicts, in one endpoint and so in both
    a, b = got[None, 1], got[2, None]
    assert a.n == 3 and a.sign_set == "=|>" and a.sign == ">" and math.isclose(a.value, 10 + (0.5 - 0.2) / 0.8 * 990) and math.isclose(a.weight, 3 * (1 + math.log10(3)))
    assert b.n == 2 and b.value == 5.0 and math.isclose(b.p_value, 9 - math.log10(5))


def test_quantiles_by_group_with_nulls(spark):
    rows = [("a", float(k)) for k in range(10)] + [(None, 4.0), (None, 5.0), ("b", None)]
    got = {r.g: r.q for r in order.quantiles(spark.createDataFrame(rows, "g string, x double"), "x", (0.0, 0.25, 0.5, 1.0), ["g"]).collect()}
    assert got == {"a": [0.0, 2.25, 4.5, 9.0], None: [4.0, 4.25, 4.5, 5.0]}
    assert one(order.quantiles(spark.createDataFrame([], "x double"), "x", [0.5])).q is None


def test_no_window_over_a_whole_subset(spark):
    """Ranks, areas and order statistics by subset: no plan gathers a subset in one window partition."""
    df = spark.range(50).select(F.col("id").cast("double").alias("y"), (F.col("id") % 7).cast("double").alias("p"), F.lit("g").alias("g"))
    for out in (metrics.spearman(df, "y", "p", "g"), metrics.roc_auc(df, F.col("y") > 3, "p", "g"), order.quantiles(df, "y", [0.5], ["g"])):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert all("__part" in line for line in plan.split("\n") if "Window [" in line)


def test_weights_that_are_not_each_others_inverse():
    assert [x[:2] for x in X.weight_asymmetry({">": 1.3, "<": 0.7, ">=": 1.0, "<=": 0.96})] == [(">", "<")]


def test_ks_p_value_and_unique_basis(spark):
    from marlstone.operators import drift

    rows = [("a", "c1", 1.0), ("a", "c1", 1.0), ("a", "c2", 2.0), ("b", "c1", 5.0), ("b", None, 6.0)]
    df = spark.createDataFrame(rows, "d string, c string, x double")
    got = one(drift.numeric_shift(df, "d", "a", "b", ["x"], basis="c"))
    assert (got.n_a, got.n_b, got.mean_a, got.sd_a, got.ks) == (2, 2, 1.5, 0.5, 1.0)
    p = one(spark.range(1).select(drift.ks_p_value(F.lit(0.2), F.lit(100.0), F.lit(100.0)).alias("p"))).p
    assert 0.025 < p < 0.04  # the exact value is 0.037, the limit with this correction 0.031


def test_nearest_of_other_rows(spark):
    rows = [(1, "abcabc"), (2, "abcabd"), (3, "abcabc"), (4, "xyzxyz"), (5, ""), (6, None)]
    df = spark.createDataFrame(rows, "k long, t string")
    got = {r.k: (round(r.similarity, 6), r.nearest) for r in text.nearest_similarity(df, df, "k", "t", others=True, part=2, block=2).collect()}
    assert got[1] == (1.0, 3) and got[3] == (1.0, 1) and got[2][1] == 1 and 0 < got[2][0] < 1 and got[4][0] == 0.0 and got[5][0] == 0.0 and got[6][0] == 0.0


def test_subwords_against_plain_merging(spark):
    texts = ["low lower lowest", "new newer newest widest", "low low low new", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    merges = text.learn_subwords(df, "t", 8, per_pass=1)
    words = [w for t in texts for w in (t or "").split()]
    parts, want = {w: list(w) for w in words}, []
    for _ in range(8):
        pairs = {}
        for w in words:
            for x in zip(parts[w][:-1], parts[w][1:], strict=True):
                pairs[x] = pairs.get(x, 0) + 1
        (a, b), n = min(pairs.items(), key=lambda x: (-x[1], x[0]))
        if n < 2:
            break
        want.append((a, b))
        for w in parts:
            out = []
            for s in parts[w]:
                if out and (out[-1], s) == (a, b):
                    out[-1] += s
                else:
                    out.append(s)
            parts[w] = out
    assert merges == want
    for r in text.apply_subwords(df, "t", merges).collect():
        assert r.subwords == [s for w in (r.t or "").split() for s in parts[w]]


def test_other_encodings_and_inferred_columns(spark, tmp_path):
    (tmp_path / "l.tsv").write_bytes("a\tb\nµ\t1\n".encode() + "é\t2\n".encode("latin-1"))
    good, _ = measurements.read_measurements(spark, str(tmp_path / "l.tsv"), {"a": "a", "b": "b"})
    assert sorted(r.a for r in good.collect()) == ["é", "µ"] or sorted(r.a for r in good.collect()) == ["µ", "é"]
    assert measurements.infer_columns(["Pred_PX", "sigma", "pred_lo"]) == {"y_pred": "Pred_PX", "sigma": "sigma", "lo": None, "hi": None, "bound": None}


def test_models_against_closed_forms_and_guards(spark):
    from marlstone.operators import model

    df = spark.range(400).select(F.col("id").alias("k"), (F.col("id") % 20).cast("double").alias("x"), ((F.col("id") % 20) * 2.0 + F.col("id") % 3).alias("y"), F.lit(1.0).alias("w"), F.when(F.col("id") % 5 == 0, "valid").otherwise("train").alias("split"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("e"))
    rows = model.assemble(df, ["x"])
    fit = model.fit_ridge(rows, "y", "w", alpha=3.0)
    train = [(r.x, r.y) for r in df.where("split = 'train'").collect()]
    mx, my = (sum(v[k] for v in train) / len(train) for k in (0, 1))
    slope = sum((x - mx) * (y - my) for x, y in train) / (sum((x - mx) ** 2 for x, _ in train) + 3.0)
    assert math.isclose(fit.coefficients[0], slope, rel_tol=1e-6)
    assert {r.e for r in model.fit_by_endpoint(rows, "e", ["x"], "y", "w").collect()} == {"a", "b"}
    scaled, mean, sd = model.scale_target(df, "y")
    assert math.isclose(mean, my) and math.isclose(one(scaled.where("split = 'train'").agg(F.avg("y_scaled").alias("m"))).m, 0.0, abs_tol=1e-9)
    holes = model.assemble(df.withColumn("x", F.when(F.col("k") != 7, F.col("x"))).withColumn("sigma", F.lit(1.0)), ["x"], invalid="keep")
    out = {r.k: r for r in model.score(holes, fit, (0.0, 1.0), 2.0, 5.0, 3.0).collect()}
    assert len(out) == 400 and out[7].y_pred is None and out[7].prob_strong is None and out[8].y_pred is not None
    with pytest.raises(ValueError, match="200 rows"):
        model.fit_sigma(fit.transform(rows).limit(50), "y", "prediction")
    shares = {r.group: r.share for r in model.grouped_importance(df.withColumn("noise", F.pmod(F.xxhash64("k"), F.lit(9)).cast("double")), {"x": ["x"], "noise": ["noise"]}, "y", "k", repeats=1).collect()}
    assert shares["x"] > 0.9


def test_selective_table_of_few_rows(spark):
    df = spark.createDataFrame([(1.0, 1.5, 0.1), (2.0, 2.0, 0.2), (3.0, 1.0, 0.9)], "y double, p double, b double")
    grid = spark.createDataFrame([(0.1,), (0.5,), (1.0,)], "threshold double")
    got = {r.threshold: r for r in conformal.selective_table(df, grid, "y", "p", "b", ranking=True).collect()}
    assert got[0.1].accepted == 1 and got[0.1].rmse is None and got[0.1].ae_q99 is None and got[0.5].ae_q99 == 0.5 and got[1.0].total == 3
    assert math.isclose(got[1.0].ci, brute_ci([(1.0, 1.5), (2.0, 2.0), (3.0, 1.0)])[1]) and got[1.0].rm2 is not None
