"""Scalar expressions over columns: text cleaning, qualified numbers, intervals, labels. Nulls give null unless said."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weight of a measurement by its qualifier.
QUALIFIER_WEIGHTS = {"=": 1.0, "≈": 0.95, ">": 1.3, "<": 0.7, ">=": 1.15, "<=": 0.85}
#: Fixed order in which signs are reported.
SIGN_ORDER = ["=", "≈", ">", "<", ">=", "<="]
#: Normal quantiles of two-sided levels.
NORMAL_Z = {0.5: 0.6744897501960817, 0.8: 1.2815515655446004, 0.9: 1.6448536269514722, 0.95: 1.959963984540054, 0.98: 2.3263478740408408, 0.99: 2.5758293035489004}
NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_suffix(c, squeeze: bool = False) -> Column:
    """Text before the first ``|``, trimmed; squeeze: without any white space."""
    out = F.trim(F.split_part(_c(c), F.lit("|"), F.lit(1)))
    return F.regexp_replace(out, r"\s+", "") if squeeze else out


def keep_alphabet(c, letters: str = "ACDEFGHIKLMNPQRSTVWY") -> Column:
    """Letters of the alphabet only, upper case; ASCII letters are picked before they are raised."""
    return F.regexp_replace(F.upper(F.regexp_replace(_c(c), "[^A-Za-z]", "")), f"[^{letters}]", "")


def letters_upper(c, only_space: bool = False) -> Column:
    return F.upper(F.regexp_replace(_c(c), r"\s+" if only_space else "[^A-Za-z]", ""))


def split_tokens(c, sep: str = r"\|") -> Column:
    """Trimmed tokens without blanks and the literal ``nan``; null gives none."""
    return F.filter(F.transform(F.split(F.coalesce(_c(c), F.lit("")), sep), lambda x: F.trim(x)), lambda x: (x != "") & (F.lower(x) != "nan"))


def first_token(c) -> Column:
    return F.get(split_tokens(c), F.lit(0))


def collapse_equivalent(c, sep: str = r"\|") -> Column:
    """The first chain if all agree in length and in their first and last three characters, else an empty text."""
    chains = split_tokens(c, sep)
    kinds = F.array_distinct(F.transform(chains, lambda x: F.struct(F.length(x), F.left(x, F.lit(3)), F.right(x, F.lit(3)))))
    return F.when(F.size(kinds) == 1, F.get(chains, F.lit(0))).otherwise(F.lit(""))


def join_nonempty(cols: Sequence, sep: str = "|") -> Column:
    return F.concat_ws(sep, F.filter(F.transform(F.array(*map(_c, cols)), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "") & (F.lower(x) != "nan")))


def extract_number(c) -> Column:
    """First number in the text; commas are left out; '', nan, none and null are null."""
    text = F.replace(F.trim(_c(c)), F.lit(","), F.lit(""))
    found = F.nullif(F.regexp_extract(text, NUMBER, 0), F.lit(""))
    return F.when(F.lower(text).isin("", "nan", "none", "null"), None).otherwise(found.try_cast("double"))


def parse_qualified(c, weights: dict[str, float] = QUALIFIER_WEIGHTS) -> Column:
    """struct<value, weight, sign>: qualifier and number of a measurement; sign ``missing`` (weight null) without a number."""
    text = F.trim(_c(c))
    number = extract_number(c)
    sign = F.when(number.isNull(), "missing")
    for prefix in (">=", "<=", ">", "<"):
        sign = sign.when(text.startswith(prefix), prefix)
    sign = sign.when(text.contains("~") | text.contains("≈") | F.lower(text).contains("about"), "≈").otherwise("=")
    weight = reduce(lambda w, k: w.when(sign == k, F.lit(weights[k])), list(weights)[1:], F.when(sign == list(weights)[0], F.lit(weights[list(weights)[0]])))
    return F.struct(number.alias("value"), weight.alias("weight"), sign.alias("sign"))


def parse_with_unit(c, units: dict[str, float]) -> Column:
    """Number times the factor of the first unit, in the given order, that the text contains; 1 without a unit."""
    text = F.trim(_c(c))
    factor = F.lit(1.0)
    for unit, value in reversed(units.items()):
        factor = F.when(text.contains(unit), F.lit(float(value))).otherwise(factor)
    return extract_number(c) * factor


def range_penalty(ranges: dict[str, tuple[float, float]], factor: float = 0.8) -> Column:
    """``factor`` for each column outside its range; null is inside."""
    return reduce(lambda a, b: a * b, [F.when((F.col(c) < lo) | (F.col(c) > hi), F.lit(factor)).otherwise(F.lit(1.0)) for c, (lo, hi) in ranges.items()])


def p_scale(c, unit: float = 1e9) -> Column:
    """-log10 of the value in units of ``unit``; positive values only."""
    return F.when(_c(c) > 0, -F.log10(F.when(_c(c) > 0, _c(c)) / unit))


def format_signed(sign, value, digits: int = 6) -> Column:
    """Sign and the value with that many significant digits and no trailing zeros; a missing or empty sign is ``=``."""
    v = _c(value).cast("double")
    size = F.floor(F.log10(F.when(v != 0, F.abs(v))))
    fixed = F.regexp_replace(F.regexp_replace(F.format_string(f"%.{digits + 6}f", F.bround(v * F.pow(F.lit(10.0), digits - 1 - size)) / F.pow(F.lit(10.0), digits - 1 - size)), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    rounded = F.when(v == 0, "0").otherwise(fixed)
    s = F.coalesce(_c(sign), F.lit(""))
    return F.when(v.isNotNull(), F.concat(F.when(s.isin("", "missing"), "=").otherwise(s), rounded))


def normalize_endpoint(c) -> Column:
    text = F.regexp_replace(F.upper(F.trim(_c(c))), "[_-]", "")
    return F.when(text.contains("IC50"), "pIC50").when(text.endswith("KI"), "pKi").when(text.endswith("KD"), "pKd").otherwise(text)


def present_columns(cols: Sequence[str], names: Sequence[str] | None = None) -> Column:
    """Names of the non-null columns in order, joined by ``|``; ``NA`` if none."""
    joined = F.concat_ws("|", *(F.when(F.col(c).isNotNull(), F.lit(n)) for c, n in zip(cols, names or cols, strict=True)))
    return F.when(joined == "", "NA").otherwise(joined)


def pair_key(*cols) -> Column:
    return F.concat_ws("||", *(_c(c).cast("string") for c in cols))


def binarize(c, t: float) -> Column:
    return (_c(c) >= t).cast("int")


def erfc_positive(x: Column) -> Column:
    """erfc for x >= 0 by Abramowitz and Stegun 7.1.26, within 1.5e-7."""
    t = 1.0 / (1.0 + 0.3275911 * x)
    return t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)


def prob_ge(pred, sigma, t: float, scale: float = 1.0) -> Column:
    """Chance that a normal value is at least t, in [0, 1]; 0 or 1 where sigma is missing or not positive."""
    z = (F.lit(t) - _c(pred)) / F.when(_c(sigma) > 0, _c(sigma) * scale)
    tail = 0.5 * erfc_positive(F.abs(z) / (2**0.5))
    return F.when(z.isNull(), F.when(_c(pred) >= t, 1.0).otherwise(0.0)).when(z >= 0, tail).otherwise(1.0 - tail)


def gaussian_interval(pred, sigma, level: float, scale: float = 1.0) -> Column:
    if level not in NORMAL_Z:
        raise ValueError(f"no quantile for level {level}")
    half = F.greatest(_c(sigma), F.lit(1e-12)) * scale * NORMAL_Z[level]
    return F.struct((_c(pred) - half).alias("lo"), (_c(pred) + half).alias("hi"))


def apply_affine(c, a: float | Column, b: float | Column, clip: tuple[float, float] | None = None) -> Column:
    out = _c(c) * b + a
    return F.greatest(F.lit(clip[0]), F.least(F.lit(clip[1]), out)) if clip else out


def affine_interval(lo, hi, a, b) -> Column:
    x, y = apply_affine(lo, a, b), apply_affine(hi, a, b)
    return F.struct(F.least(x, y).alias("lo"), F.greatest(x, y).alias("hi"))


def finite(*cols) -> Column:
    one = lambda c: _c(c).isNotNull() & ~F.isnan(_c(c).cast("double")) & (F.abs(_c(c).cast("double")) < float("inf"))
    return reduce(lambda a, b: a & b, map(one, cols))


def sigma_from_log(s, squared: bool = True, low: float = 1e-6, high: float = 1e6) -> Column:
    x = F.greatest(F.lit(-50.0), F.least(F.lit(50.0), _c(s)))
    return F.greatest(F.lit(low), F.least(F.lit(high), F.exp(x / 2 if squared else x)))


def residual_target(y, p, kind: str = "squared", eps: float = 1e-6) -> Column:
    e = _c(y) - _c(p)
    return F.log(e * e + eps) if kind == "squared" else F.log(F.abs(e) + eps)


def gain(metric, a, b) -> Column:
    """Improvement of b over a: less error or more of any other metric is better."""
    return F.when(F.upper(_c(metric)).isin("RMSE", "MSE", "MAE"), _c(a) - _c(b)).otherwise(_c(b) - _c(a))


#: Absolute errors of candidates: good up to the first, moderate up to the second, bad from the third on.
CANDIDATE_ERRORS = (0.30, 0.60, 1.00)


def label_candidate(score, width, error, q: dict[str, Column | float], errors: tuple[float, float, float] = CANDIDATE_ERRORS) -> Column:
    """struct of score, interval and error levels by the thresholds in q (very, high, narrow, wide) and ``errors``.

    A missing error is ``mid``, as is one between moderate and bad.
    """
    good, moderate, bad = errors
    return F.struct(
        F.when(_c(score) >= q["very"], "very_high").when(_c(score) >= q["high"], "high").otherwise("other").alias("score_level"),
        F.when(_c(width) <= q["narrow"], "narrow").when(_c(width) >= q["wide"], "wide").otherwise("mid").alias("interval_level"),
        F.when(_c(error) <= good, "good").when(_c(error) <= moderate, "moderate").when(_c(error) >= bad, "bad").otherwise("mid").alias("error_level"),
    )


def novelty_label(seen, valid, acyclic, known_scaffold) -> Column:
    """First that holds: seen, invalid, acyclic, known_scaffold, novel_scaffold. Null flags are false: without a known ``valid`` a row is invalid."""
    no = lambda c: F.coalesce(_c(c), F.lit(False))
    return F.when(no(seen), "seen").when(~no(valid), "invalid").when(no(acyclic), "acyclic").when(no(known_scaffold), "known_scaffold").otherwise("novel_scaffold")


def similarity_label(seen, similarity) -> Column:
    return F.when(F.coalesce(_c(seen), F.lit(False)), "seen").when(_c(similarity) >= 0.9, ">=0.90").when(_c(similarity) >= 0.7, ">=0.70").otherwise("low")


def quantile_bin_label(y, q: Column) -> Column:
    """Label by q05, q25, q50, q75, q95 in the struct q: ``<q05`` to ``q75-q95`` (closed above), else ``>q95``."""
    return F.when(_c(y) < q["q05"], "<q05").when(_c(y) < q["q25"], "q05-q25").when(_c(y) < q["q50"], "q25-q50").when(_c(y) < q["q75"], "q50-q75").when(_c(y) <= q["q95"], "q75-q95").otherwise(">q95")


def weight_asymmetry(weights: dict[str, float] = QUALIFIER_WEIGHTS, tolerance: float = 0.05) -> list[tuple[str, str, float]]:
    """Opposite qualifiers whose weights' product is further from 1 than ``tolerance``."""
    return [(a, b, weights[a] * weights[b]) for a, b in ((">", "<"), (">=", "<=")) if abs(weights[a] * weights[b] - 1) > tolerance]
