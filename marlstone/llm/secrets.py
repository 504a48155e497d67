"""Secret scans: base patterns and a randomness test battery, in DataFrame expressions only.

Base patterns (assign, access, hex) give spans by their shape. The battery adds spans of kind ``random``: unbroken
runs of 20 or more letters of an encoding's alphabet. For each such run the encoding is inferred from its letters and
its letters' places in that alphabet are tested:

* chi-squared against a uniform alphabet; under "this is language" the statistic is non-central, with a non-centrality
  that grows with the length, so the p-value of the discovery falls with the length (length-aware);
* a runs test about the middle of the alphabet and a lag-1 serial correlation, which a random run must pass.

Within a document the runs that pass those tests are the family; the discoveries are those that the step-up
false-discovery rule keeps at level q, p-values weighted by length (weights average 1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
#: (name, letters in order, share of pairs of equal letters expected of language written with them). Tried in order.
ENCODINGS = [
    ("hex", "0123456789abcdef", 0.12),
    ("hex upper", "0123456789ABCDEF", 0.12),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.066),
    ("lower", "abcdefghijklmnopqrstuvwxyz", 0.066),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz", 0.06),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_", 0.055),
]
KINDS = ("assign", "access", "hex", "random")


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _blocks(values: Column) -> Column:
    """The array in slices of about the square root of its size, so that work that grows with the square of a slice stays small."""
    width = F.greatest(F.ceil(F.sqrt(F.size(values))).cast("int"), F.lit(1))
    firsts = F.when(F.size(values) > 0, F.sequence(F.lit(1), F.size(values), width)).otherwise(F.array().cast("array<int>"))
    return F.transform(firsts, lambda k: F.slice(values, k, width))


def _running(values: Column, add, zero: int) -> Column:
    """What ``add`` (a sum or a maximum) makes of each value of an array<int> and those before it."""

    def scan(part: Column) -> Column:
        start = F.struct(F.lit(zero).alias("at"), F.array().cast("array<int>").alias("out"))

        def step(acc, x):
            return _let(add(acc["at"], x), lambda now: F.struct(now.alias("at"), F.array_append(acc["out"], now).alias("out")))

        return F.aggregate(part, start, step)

    def joined(parts: Column) -> Column:
        before = scan(F.transform(parts, lambda p: p["at"]))["out"]
        return _let(before, lambda b: F.flatten(F.transform(parts, lambda p, k: F.when(k == 0, p["out"]).otherwise(_let(F.get(b, k - 1), lambda base: F.transform(p["out"], lambda x: add(base, x)))))))

    return _let(values, lambda v: _let(F.transform(_blocks(v), scan), joined))


def _sum(a: Column, b: Column) -> Column:
    return a + b


def _found(text: Column, pattern: str, group: int | None, least: int) -> Column:
    """array<struct<start,end,body>> of the pattern's leftmost matches whose body (group or all) has ``least`` letters.

    What lies between the matches (split) and the matches themselves alternate, so running lengths give the places.
    """
    pieces = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    body = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    rows = _let(whole, lambda w: F.zip_with(F.slice(pieces, F.lit(1), F.size(w)), w, lambda gap, x: F.struct((gap + F.length(x)).alias("step"), F.length(x).alias("size"))))

    def spans(rows: Column) -> Column:
        ends = _running(F.transform(rows, lambda x: x["step"]), _sum, 0)
        placed = F.zip_with(rows, ends, lambda x, end: F.struct((end - x["size"]).alias("start"), end.alias("end")))
        return F.zip_with(placed, body, lambda x, said: F.struct(x["start"].alias("start"), x["end"].alias("end"), said.alias("body")))

    return F.filter(_let(rows, spans), lambda s: F.length(s["body"]) >= least)


def _apart(runs: Column, base: Column) -> Column:
    """The runs that no base span overlaps: of those that begin no later none ends in the run, and the next one begins after it.

    Runs and spans are sorted by start together; the largest end before each and the smallest start after it are running maxima.
    """
    of = lambda s, kind, body: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"), body.alias("body"))
    events = F.array_sort(F.concat(F.transform(base, lambda s: of(s, 0, F.lit(""))), F.transform(runs, lambda s: of(s, 1, s["body"]))))
    none = -(2**31) + 1

    def judged(events: Column) -> Column:
        before = _running(F.transform(events, lambda e: F.when(e["kind"] == 0, e["end"]).otherwise(F.lit(none))), F.greatest, none)
        after = F.reverse(_running(F.reverse(F.transform(events, lambda e: F.when(e["kind"] == 0, -e["start"]).otherwise(F.lit(none)))), F.greatest, none))
        both = F.zip_with(before, after, lambda x, y: F.struct(x.alias("end"), (-y).alias("start")))
        told = F.zip_with(events, both, lambda e, near: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["body"].alias("body"), ((e["kind"] == 1) & (near["end"] <= e["start"]) & (near["start"] >= e["end"])).alias("free")))
        return F.filter(told, lambda e: e["free"])

    return F.when(F.size(base) > 0, _let(events, judged)).otherwise(F.transform(runs, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["body"].alias("body"), F.lit(True).alias("free"))))


def _kind(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["end"].alias("end")))


def _written(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def normal_cdf(z: Column) -> Column:
    """Phi by the logistic form 1 / (1 + exp(-1.5976 z - 0.070565 z^3)), within 2e-4."""
    z = F.greatest(F.lit(-12.0), F.least(F.lit(12.0), z))
    return F.lit(1.0) / (1.0 + F.exp(-1.5976 * z - 0.070565 * z * z * z))


def battery(body: Column) -> Column:
    """struct<p, p_runs, p_serial>: p of "language" (small: a random alphabet), p of "random" by runs and by serial correlation.

    Null where no encoding has all the letters."""
    two_sided = lambda z: 2.0 * normal_cdf(-F.abs(z))
    known = F.filter(F.array(*(F.struct(F.lit(x).alias("letters"), F.lit(float(len(x))).alias("cells"), F.lit(c).alias("coincidence")) for _, x, c in ENCODINGS)), lambda e: F.call_function("translate", body, e["letters"], F.lit("")) == "")

    def tests(e: Column) -> Column:
        chars = F.filter(F.split(body, ""), lambda c: c != "")
        return _let(F.transform(chars, lambda c: (F.instr(e["letters"], c) - 1).cast("double")), lambda places: judged(e["cells"], e["coincidence"], places))

    def judged(cells: Column, coincidence: Column, places: Column) -> Column:
        size, middle = F.size(places).cast("double"), (cells - 1.0) / 2.0
        squares = F.aggregate(F.array_distinct(places), F.lit(0.0), lambda a, x: a + F.pow(F.size(F.filter(places, lambda y: y == x)).cast("double"), F.lit(2.0)))
        pairs = F.zip_with(F.slice(places, F.lit(1), F.size(places) - 1), F.slice(places, F.lit(2), F.size(places) - 1), lambda x, y: F.struct(x.alias("a"), y.alias("b")))
        zero = F.struct(*(F.lit(0.0).alias(c) for c in ("a", "b", "ab", "aa", "turns")))
        moments = F.aggregate(pairs, zero, lambda m, x: F.struct((m["a"] + x["a"]).alias("a"), (m["b"] + x["b"]).alias("b"), (m["ab"] + x["a"] * x["b"]).alias("ab"), (m["aa"] + x["a"] * x["a"]).alias("aa"), (m["turns"] + F.when((x["a"] > middle) != (x["b"] > middle), 1.0).otherwise(0.0)).alias("turns")))
        sums = F.struct(size.alias("n"), squares.alias("squares"), F.size(F.filter(places, lambda x: x > middle)).cast("double").alias("high"), (F.aggregate(places, F.lit(0.0), lambda a, x: a + x) / size).alias("mean"), moments.alias("m"))
        return _let(sums, lambda t: statistics(cells, coincidence, t))

    def statistics(cells: Column, coincidence: Column, t: Column) -> Column:
        n, high, mean, m, degrees = t["n"], t["high"], t["mean"], t["m"], cells - 1.0
        over = n * (cells * coincidence - 1.0)
        p = normal_cdf((t["squares"] * cells / n - n - degrees - over) / F.sqrt(2.0 * (degrees + 2.0 * over)))
        expected = 1.0 + 2.0 * high * (n - high) / n
        runs = (1.0 + m["turns"] - expected) / F.sqrt(F.greatest((expected - 1.0) * (expected - 2.0) / (n - 1.0), F.lit(1e-9)))
        xy = m["ab"] - mean * (m["a"] + m["b"]) + (n - 1.0) * mean * mean
        xx = m["aa"] - 2.0 * mean * m["a"] + (n - 1.0) * mean * mean
        serial = xy / F.greatest(xx, F.lit(1e-9)) * F.sqrt(n)
        return F.struct(p.alias("p"), two_sided(runs).alias("p_runs"), two_sided(serial).alias("p_serial"))

    return F.get(F.transform(F.slice(known, 1, 1), tests), F.lit(0))


def _discoveries(spans: Column, q: float, alpha: float) -> Column:
    """Spans that the weighted step-up rule keeps: the k-th smallest p / weight at most q k / m.

    The family is the document's m runs that pass both randomness tests; a run's weight is its length over the family's
    mean length, so that weights average 1, as the rule asks.
    """

    def step_up(family: Column) -> Column:
        mean = F.try_divide(F.aggregate(family, F.lit(0.0), lambda a, s: a + F.length(s["body"])), F.size(family))
        judged = F.transform(F.array(mean), lambda m: F.array_sort(F.transform(family, lambda s: F.struct((s["t"]["p"] * m / F.length(s["body"])).alias("p"), s["start"].alias("start"), s["end"].alias("end")))))
        cut = lambda ranked: F.array_max(F.transform(ranked, lambda s, k: F.when(s["p"] * F.size(ranked) <= q * (k + 1), s["p"])))
        kept = F.transform(judged, lambda ranked: F.get(F.transform(F.array(cut(ranked)), lambda c: F.filter(ranked, lambda s: F.coalesce(s["p"] <= c, F.lit(False)))), F.lit(0)))
        return F.get(kept, F.lit(0))

    random = F.filter(spans, lambda s: F.least(s["t"]["p_runs"], s["t"]["p_serial"]) * 2.0 >= alpha)
    return F.get(F.transform(F.array(random), step_up), F.lit(0))


def scan_secrets(df: DataFrame, text: str = "text", q: float = 0.01, alpha: float = 0.002) -> DataFrame:
    """Adds ``secrets``: array<struct<start:int, rank:int, end:int>> by start, in code points, end exclusive (rank: place in KINDS).

    Null and empty texts give an empty array. The whole text is scanned; other columns pass unchanged; a column
    already named ``secrets`` is replaced; repeated rows give repeated results, an empty table an empty one.
    """
    keep = [c for c in df.columns if c != "secrets"]
    none = F.array().cast("array<struct<start:int,end:int,body:string>>")
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lazily = lambda pattern, found: F.when(t.rlike(pattern), found).otherwise(none)
    row = F.struct(*(F.col(f"`{c}`") for c in keep))  # so that no column of theirs meets one of ours
    step = df.select(
        row.alias("__row"),
        F.struct(
            lazily(ASSIGN, _found(t, ASSIGN, 2, 6)).alias("assign"),
            lazily(ACCESS, _found(t, ACCESS, None, 20)).alias("access"),
            lazily(HEX.replace("+", "{24,}"), _found(t, HEX.replace("+", "{24,}"), None, 24)).alias("hex"),
            lazily(CANDIDATE, _found(t, CANDIDATE, None, 20)).alias("run"),
        ).alias("__found"),
    )
    found = F.col("__found")
    base = F.concat(*(_kind(found[k], k) for k in KINDS[:3]))
    step = step.select("__row", base.alias("__base"), found["run"].alias("__run"))
    free = F.when(F.size("__run") > 0, _apart(F.col("__run"), F.col("__base")))
    step = step.select("__row", "__base", F.transform(free, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["body"].alias("body"), battery(s["body"]).alias("t"))).alias("__run"))
    added = F.when(F.size("__run") > 0, _kind(_discoveries(F.col("__run"), q, alpha), "random")).otherwise(F.array().cast("array<struct<start:int,rank:int,end:int>>"))
    return step.select(*(F.col("__row").getField(c).alias(c) for c in keep), F.array_sort(F.concat("__base", added)).alias("secrets"))


def span_text(secrets: Column, base_only: bool = False) -> Column:
    return _written(F.filter(secrets, lambda s: s["rank"] < 3) if base_only else secrets)


def redact(df: DataFrame, text: str = "text", secrets: str = "secrets", mark: str = "[SECRET]") -> DataFrame:
    """``text`` with each span replaced by ``mark``; spans that overlap are replaced as one. No spans: as it is (null stays null)."""
    t = F.col(f"`{text}`")
    ends = _running(F.transform(F.col(secrets), lambda s: s["end"]), F.greatest, 0)
    # each span with the end of what is written before it
    rows = _let(ends, lambda e: F.transform(F.col(secrets), lambda s, k: F.struct(F.when(k > 0, F.get(e, k - 1)).otherwise(F.lit(0)).alias("at"), s["start"].alias("start"))))

    def told(part: Column) -> Column:
        first = F.get(part, F.lit(0))["at"]
        near = F.substring(t, first + 1, F.greatest(F.element_at(part, F.lit(-1))["start"] - first, F.lit(0)))  # places in the whole text are found by counting from its start
        piece = lambda n, s: F.concat(F.substring(n, s["at"] - first + 1, F.greatest(s["start"] - s["at"], F.lit(0))), F.when(s["start"] >= s["at"], F.lit(mark)).otherwise(F.lit("")))
        return _let(near, lambda n: F.array_join(F.transform(part, lambda s: piece(n, s)), ""))

    written = F.array_join(F.transform(_let(rows, _blocks), told), "")
    rest = F.substring(t, F.array_max(F.transform(F.col(secrets), lambda s: s["end"])) + 1, F.length(t))
    return df.withColumn(text, F.when(F.size(secrets) > 0, F.concat(written, rest)).otherwise(t))
