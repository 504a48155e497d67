"""Calibration, conformal bounds and selection. Fits are small tables (one row a bin, endpoint or level) joined by broadcast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.expr import CANDIDATE_ERRORS, finite, label_candidate
from marlstone.functions.shared import written
from marlstone.operators.metrics import abs_error_shares, concordance, coverage_metrics, rm2
from marlstone.operators.order import keep_best, qcut, quantiles, running, top_n


def fit_affine(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """by, a, b, n of y = a + b p by least squares; fewer than two rows or no spread: 0 and 1. Pass the fit split only."""
    rows = df.where(finite(y, p))
    s = rows.groupBy(*by).agg(F.count("*").alias("n"), F.regr_intercept(y, p).alias("a"), F.regr_slope(y, p).alias("b"))
    ok = (F.col("n") >= 2) & F.col("b").isNotNull()
    return s.select(*by, F.when(ok, F.col("a")).otherwise(0.0).alias("a"), F.when(ok, F.col("b")).otherwise(1.0).alias("b"), "n")


def bin_of(c: Column, edges: Column) -> Column:
    """Place of a value among ascending edges: right-open bins, the last closed, clamped outside."""
    inner = F.slice(edges, F.lit(2), F.greatest(F.size(edges) - 2, F.lit(0)))
    return F.size(F.filter(inner, lambda e: e <= c))


def fit_binned_conformal(df: DataFrame, y: str, p: str, alpha: float = 0.1, bins: int = 10, least: int = 30) -> DataFrame:
    """bin, n, q, edges: the error quantile (linear) at 1 - alpha of each prediction bin, or the global one.

    A bin below ``least`` rows takes the global quantile; fewer than four distinct edges give one bin; fewer than 50
    rows are an error.
    """
    rows = df.where(finite(y, p)).select(F.col(p).alias("p"), F.abs(F.col(y) - F.col(p)).alias("e"))
    edges = quantiles(rows, "p", [k / bins for k in range(bins + 1)], name="edges")
    whole = edges.crossJoin(F.broadcast(quantiles(rows, "e", [1 - alpha]))).crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))
    whole = whole.select("total", F.get("q", F.lit(0)).alias("global_q"), F.array_distinct("edges").alias("edges"))
    whole = whole.withColumn("edges", F.when(F.size("edges") >= 4, F.col("edges")).otherwise(F.array(F.get("edges", F.lit(0)), F.element_at("edges", -1))))
    whole = whole.withColumn("global_q", F.when(F.col("total") < 50, F.raise_error(F.lit("conformal fit needs 50 rows"))).otherwise(F.col("global_q")))
    placed = rows.crossJoin(F.broadcast(whole)).withColumn("bin", bin_of(F.col("p"), F.col("edges")))
    counts = placed.groupBy("bin").agg(F.count("*").alias("n"), F.first("global_q").alias("global_q"), F.first("edges").alias("edges"))
    fitted = counts.join(quantiles(placed, "e", [1 - alpha], ["bin"]).select("bin", F.col("q")[0].alias("own")), "bin")
    return fitted.select("bin", "n", F.when(F.col("n") >= least, F.col("own")).otherwise(F.col("global_q")).alias("q"), "global_q", "edges")


def apply_binned_conformal(df: DataFrame, fitted: DataFrame, p: str, name: str = "err_bound") -> DataFrame:
    """Adds the bound of the row's bin; a bin not met in the fit has the global quantile."""
    table = fitted.agg(F.map_from_entries(F.collect_list(F.struct("bin", "q"))).alias("__m"), F.first("edges").alias("__edges"), F.first("global_q").alias("__g"))
    out = df.crossJoin(F.broadcast(table))
    return out.withColumn(name, F.when(finite(p), F.coalesce(F.try_element_at("__m", bin_of(F.col(p), F.col("__edges"))), F.col("__g")))).drop("__m", "__edges", "__g")


def fit_sigma_conformal(df: DataFrame, y: str, p: str, sigma: str, alpha: float = 0.1, eps: float = 1e-8) -> DataFrame:
    """q_scale (the quantile, linear, of error over sigma) and n."""
    ratio = running(df.where(finite(y, p, sigma)).select((F.abs(F.col(y) - F.col(p)) / F.greatest(F.col(sigma), F.lit(eps))).alias("x")), "x")
    spot = F.lit(1 - alpha) * (F.col("n") - 1)
    at = lambda place: F.max(F.when((F.col("before") <= place) & (F.col("before") + F.col("k") > place), F.col("value")))
    found = ratio.agg(at(F.floor(spot)).alias("a"), at(F.ceil(spot)).alias("b"), F.max(spot - F.floor(spot)).alias("f"), F.coalesce(F.max("n"), F.lit(0)).alias("n"))
    return found.select((F.col("a") + F.col("f") * (F.col("b") - F.col("a"))).alias("q_scale"), "n")


def fit_split_conformal(df: DataFrame, y: str, p: str, sigma: str, endpoint: str, levels: Sequence[float] = (0.8, 0.9, 0.95)) -> DataFrame:
    """level, method (normalised, global, endpoint), endpoint, q, n: element ceil((n + 1) level) of the scores.

    An endpoint below two rows takes the global quantile.
    """
    rows = df.where(finite(y, p, sigma) & (F.col(sigma) > 0)).withColumn("__e", F.abs(F.col(y) - F.col(p)))
    kinds = F.array(*(F.struct(F.lit(m).alias("method"), e.alias("endpoint"), v.alias("x")) for m, e, v in (("normalised", F.lit("all"), F.col("__e") / F.col(sigma)), ("global", F.lit("all"), F.col("__e")), ("endpoint", F.col(endpoint).cast("string"), F.col("__e")))))
    run = running(rows.select(F.inline(kinds)), "x", ["method", "endpoint"])  # one running count for all methods and levels
    run = run.withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    place = F.greatest(F.lit(1), F.least(F.col("n"), F.ceil(F.round((F.col("n") + 1) * F.col("level"), 9))))
    fits = run.where(F.col("before") + F.col("k") >= place).groupBy("level", "method", "endpoint").agg(F.min("value").alias("q"), F.max("n").alias("n"))
    whole = fits.where("method = 'global'").select("level", F.col("q").alias("__g"))
    fits = fits.join(F.broadcast(whole), "level")
    return fits.select("level", "method", "endpoint", F.when((F.col("method") == "endpoint") & (F.col("n") < 2), F.col("__g")).otherwise(F.col("q")).alias("q"), "n")


def conformal_widths(df: DataFrame, fitted: DataFrame, sigma: str, endpoint: str) -> DataFrame:
    """Rows times (level, method) with the half-width ``half`` of each; an endpoint without fit takes the global quantile."""
    table = fitted.groupBy("level").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "method", "endpoint"), "q"))).alias("__q"))
    rows = df.crossJoin(F.broadcast(table)).withColumn("method", F.explode(F.array(F.lit("normalised"), F.lit("global"), F.lit("endpoint"))))
    whole = F.try_element_at("__q", F.lit("global:all"))
    half = F.when(F.col("method") == "normalised", F.try_element_at("__q", F.lit("normalised:all")) * F.col(sigma)).when(F.col("method") == "global", whole).otherwise(F.coalesce(F.try_element_at("__q", F.concat(F.lit("endpoint:"), F.col(endpoint).cast("string"))), whole))
    return rows.withColumn("half", half).drop("__q")


def evaluate_conformal(df: DataFrame, fitted: DataFrame, y: str, p: str, sigma: str, endpoint: str) -> DataFrame:
    """Coverage block by level, method and endpoint."""
    rows = conformal_widths(df, fitted, sigma, endpoint)
    return coverage_metrics(rows, y, p, "half", F.col("level"), ["level", "method", endpoint])


def uncertainty_deciles(df: DataFrame, y: str, p: str, sigma: str, q: float, level: float, n: int = 10) -> DataFrame:
    rows = qcut(df.where(finite(y, p, sigma)), sigma, n, "decile").withColumn("half", F.col(sigma) * q)
    return coverage_metrics(rows, y, p, "half", F.lit(level), ["decile"])


def selective_table(df: DataFrame, grid: DataFrame, y: str, p: str, bound: str, q: float = 0.99, ranking: bool = False) -> DataFrame:
    """threshold, accepted, total, coverage, reject_rate, rmse, r2 and ae_q<100 q> of the rows whose bound is at most each
    threshold of ``grid``; ranking: also ci and rm2.

    The grid is a handful of thresholds (column ``threshold``); two or fewer rows have no metrics.
    """
    rows = df.where(finite(y, p, bound)).select(F.col(y).alias("y"), F.col(p).alias("p"), F.col(bound).alias("b"))
    total = rows.agg(F.count("*").alias("total"))
    held = rows.join(F.broadcast(grid.select("threshold")), F.col("b") <= F.col("threshold"))
    means = held.groupBy("threshold").agg(F.avg("y").alias("m"))
    e = F.col("y") - F.col("p")
    s = held.join(F.broadcast(means), "threshold").groupBy("threshold").agg(F.count("*").alias("accepted"), F.sum(e * e).alias("sse"), F.sum((F.col("y") - F.col("m")) * (F.col("y") - F.col("m"))).alias("sst"))
    out = grid.select("threshold").join(s, "threshold", "left").crossJoin(F.broadcast(total))
    n, error = F.coalesce("accepted", F.lit(0)), f"ae_q{round(100 * q)}"
    out = out.select("threshold", n.alias("accepted"), "total", (n / F.col("total")).alias("coverage"), (1 - n / F.col("total")).alias("reject_rate"), F.when(n >= 2, F.sqrt(F.col("sse") / n)).alias("rmse"), F.when((n >= 2) & (F.col("sst") > 0), 1 - F.col("sse") / F.col("sst")).alias("r2"))
    named = held.withColumn("threshold", F.col("threshold").cast("string"))
    parts = [abs_error_shares(named, "y", "p", by="threshold", q=q).select("subset", error)]
    if ranking:
        parts += [concordance(named, "y", "p", "threshold").select("subset", "ci"), rm2(named, "y", "p", "threshold").select("subset", "rm2")]
    for part in parts:
        few = [F.when(F.col("accepted") >= 2, F.col(c)).alias(c) for c in part.columns[1:]]
        out = out.join(part, F.col("threshold").cast("string") == F.col("subset"), "left").select(*out.columns, *few)
    return out


def selective_curve(df: DataFrame, y: str, p: str, bound: str, points: int = 19) -> DataFrame:
    """``selective_table`` at the bound's quantiles of evenly spaced coverages up to 0.95: the coverage and error curves."""
    targets = [0.95 * (k + 1) / points for k in range(points)]
    return selective_table(df, err_max_for_coverage(df, bound, targets).select(F.col("err_max").alias("threshold")).distinct(), y, p, bound)


def err_max_for_coverage(df: DataFrame, bound: str, targets: Sequence[float]) -> DataFrame:
    """target, err_max: the bound's quantile (linear) at each target coverage."""
    qs = quantiles(df.where(finite(bound)), bound, targets)
    return qs.select(F.inline(F.arrays_zip(F.array(*map(F.lit, targets)).alias("target"), F.col("q").alias("err_max"))))


def calibrate_intervals(df: DataFrame, a: float, b: float, p: str, lo: str, hi: str, bound: str | None = None, sigma: str | None = None, q: float = 1.0) -> DataFrame:
    """Adds p_cal, lo_cal, hi_cal, half_cal: lo/hi if present, else p -+ bound, else p -+ q sigma; scaled by |b|."""
    half = F.coalesce((F.col(hi) - F.col(lo)) / 2, F.col(bound) if bound else F.lit(None).cast("double"), F.col(sigma) * q if sigma else F.lit(None).cast("double"))
    x, z = F.coalesce(F.col(lo), F.col(p) - half) * b + a, F.coalesce(F.col(hi), F.col(p) + half) * b + a
    return df.withColumns({"p_cal": F.col(p) * b + a, "lo_cal": F.least(x, z), "hi_cal": F.greatest(x, z), "half_cal": half * abs(b)})


def replay_mapping(df: DataFrame, a: float, b: float, p: str, stored: str, tolerance: float = 1e-10) -> DataFrame:
    return df.agg(F.max(F.abs(F.col(p) * b + a - F.col(stored))).alias("worst")).select("worst", (F.col("worst") <= tolerance).alias("ok"))


def half_width(df: DataFrame, lo: str, hi: str, p: str, tolerance: float = 1e-6) -> DataFrame:
    """Adds half_width and consistent (the prediction is the middle and lo is not above hi)."""
    return df.withColumns({"half_width": (F.col(hi) - F.col(lo)) / 2, "consistent": (F.col(hi) >= F.col(lo)) & (F.abs((F.col(hi) + F.col(lo)) / 2 - F.col(p)) <= tolerance)})


def labelled_candidates(df: DataFrame, keys: Sequence[str], score: str, bound: str, error: str, floors=(8.0, 8.5), errors=CANDIDATE_ERRORS) -> DataFrame:
    """The row of each key with the smallest error (then bound), with the struct ``level`` and the thresholds as the struct ``q``.

    Rows without a key or with a non-finite score, bound or error are left out. Thresholds over the rows kept: score
    max(floor, q90) and max(floor, q95), bound q25 and q75.
    """
    whole = df.where(finite(score, bound, error)).dropna(subset=list(keys))
    best = keep_best(whole, keys, [F.col(error), F.col(bound), *(F.col(k) for k in df.columns if k not in (error, bound))])
    s, b = F.col("s"), F.col("b")
    both = quantiles(best, score, (0.9, 0.95), name="s").crossJoin(F.broadcast(quantiles(best, bound, (0.25, 0.75), name="b")))
    q = both.select(F.struct(F.greatest(F.lit(floors[0]), s[0]).alias("high"), F.greatest(F.lit(floors[1]), s[1]).alias("very"), b[0].alias("narrow"), b[1].alias("wide")).alias("q"))
    return best.crossJoin(F.broadcast(q)).withColumn("level", label_candidate(score, bound, error, {k: F.col("q")[k] for k in ("high", "very", "narrow", "wide")}, errors))


def candidate_classes(score: str, bound: str, error: str, errors=CANDIDATE_ERRORS) -> dict[str, tuple[Column, list[Column]]]:
    """Condition and order of each class over the rows of ``labelled_candidates``; all have a high score."""
    q, high = F.col("q"), F.col(score) >= F.col("q.high")
    narrow, wide, good, far = F.col(bound) <= q["narrow"], F.col(bound) >= q["wide"], F.col(error) <= errors[0], F.col(error) >= errors[1]
    down, e, b = F.desc(score), F.col(error), F.col(bound)
    return {
        "narrow_good": (high & narrow & good, [down, e.asc(), b.asc()]),
        "wide_good": (high & wide & good, [down, e.asc(), b.desc()]),
        "wide_far": (high & wide & far, [down, e.desc(), b.desc()]),
    }


def select_candidates(df: DataFrame, keys: Sequence[str], score: str, bound: str, error: str, n: int = 20, floors=(8.0, 8.5), errors=CANDIDATE_ERRORS) -> DataFrame:
    """candidate_class and the columns of df: the best row of each key, the first n of each class in the class's own order
    (further ties by key). A row that fits two classes stands in both."""
    rows, out = written(labelled_candidates(df, keys, score, bound, error, floors, errors)), None
    for name, (fits, order) in candidate_classes(score, bound, error, errors).items():
        part = top_n(rows.where(fits), [*order, *(F.col(k) for k in keys)], n).select(F.lit(name).alias("candidate_class"), *df.columns)
        out = part if out is None else out.unionByName(part)
    return out


def candidate_summary(df: DataFrame, keys: Sequence[str], endpoint: str, score: str, bound: str, error: str, n: int = 20, floors=(8.0, 8.5), errors=CANDIDATE_ERRORS) -> DataFrame:
    """section, name, value: rows kept, rows by endpoint, the thresholds, and how many candidates each class gives."""
    rows = written(labelled_candidates(df, keys, score, bound, error, floors, errors))
    classes = candidate_classes(score, bound, error, errors)
    fit = {k: F.least(F.lit(n), F.count_if(c)) for k, (c, _) in classes.items()}
    cell = lambda section, name, v: F.struct(F.lit(section).alias("section"), F.lit(name).alias("name"), v.cast("double").alias("value"))
    sums = rows.agg(F.count("*").alias("rows"), F.first("q").alias("q"), *(v.alias(k) for k, v in fit.items()))
    cells = [cell("rows", "all", F.col("rows")), *(cell("threshold", k, F.col(f"q.{k}")) for k in ("high", "very", "narrow", "wide")), *(cell("threshold", k, F.lit(v)) for k, v in zip(("good", "moderate", "bad"), errors, strict=True))]
    cells += [*(cell("class", k, F.col(k)) for k in classes), cell("class", "all", sum(F.col(k) for k in classes))]
    out = sums.select(F.explode(F.array(*cells)).alias("x")).select("x.*")
    return out.unionByName(rows.groupBy(endpoint).agg(F.count("*").cast("double").alias("value")).select(F.lit("endpoint").alias("section"), F.coalesce(F.col(endpoint).cast("string"), F.lit("NA")).alias("name"), "value"))
