"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
WORDY = r"[^\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"
#: Fixed list: frequent function words of the languages in use.
STOP_WORDS = sorted(
    set(
        "the of and to in a is that for it was on are as with his they at be this from have or by one had not but what all were when we there can an your which their "
        "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec "
        "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei "
        "el que y los del se las por un con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre".split()
    )
)
#: Rule name, the ratio it looks at, smallest and largest value that is kept (None: open).
THRESHOLDS: list[tuple[str, str, float | None, float | None]] = [
    ("word_length", "mean_word_chars", 1.5, 15.0),
    ("symbols", "symbol_ratio", None, 0.5),
    ("stop_words", "stop_ratio", 0.01, None),
    ("repeated_lines", "dup_line_ratio", None, 0.6),
    ("upper_case", "upper_ratio", None, 0.5),
]


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``quality_measures``, a struct of counts and ratios of the whole text (null: empty).

    n_words (runs without white space), word_chars (code points in them), n_symbols, n_lines (with a word),
    n_dup_lines (equal to an earlier line), n_repeat_words (words in windows of three words that occur twice or more),
    n_stop (stop words) and n_upper (upper-case ASCII letters). Ratios of an empty text are 0. Windows are told apart by
    a 64-bit hash of their three words. Other columns pass, whatever their names; a column already named so is replaced.
    Repeated rows give repeated results, an empty table an empty one.
    """
    names = [c for c in df.columns if c != "quality_measures"]
    df = df.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("__row"))  # so that no column of theirs meets one of ours
    keep = [F.col("__row")]
    t = F.coalesce(F.col("__row").getField(text), F.lit(""))
    plain = F.regexp_replace(t, SPACES, "")
    step = df.select(
        *keep,
        F.filter(F.split(t, SPACES, -1), lambda w: w != "").alias("__words"),
        F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORDY)).alias("__lines"),
        F.length(plain).alias("__chars"),
        (F.length(plain) - F.length(F.regexp_replace(plain, SYMBOLS + "+", ""))).alias("__symbols"),
        F.length(F.regexp_replace(plain, "[^A-Z]+", "")).alias("__upper"),
    )
    words = F.col("__words")
    counts = [F.size("__lines").alias("__n_lines"), (F.size("__lines") - F.size(F.array_distinct("__lines"))).alias("__dup_lines"), "__chars", "__symbols", "__upper"]
    windows = F.when(F.size(words) >= 3, F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))))
    step = step.select(*keep, *counts, F.size(words).alias("__n"), F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))).alias("__stop"), F.coalesce(windows, F.array().cast("array<bigint>")).alias("__windows"))
    rest = [*keep, "__n_lines", "__dup_lines", "__chars", "__symbols", "__upper", "__n", "__stop"]
    # Most texts repeat no window: one primitive sort tells; only the others are sorted again with places.
    step = step.select(*rest, "__windows", F.sort_array("__windows").alias("__sorted"))
    repeats = F.exists(F.sequence(F.lit(1), F.greatest(F.size("__sorted") - 1, F.lit(1))), lambda i: F.get(F.col("__sorted"), i) == F.get(F.col("__sorted"), i - 1))
    placed = F.when(F.coalesce(repeats, F.lit(False)), F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    step = step.select(*rest, placed.alias("__placed"))
    same = F.transform("__placed", lambda x, k: F.when(F.coalesce(F.get(F.col("__placed"), k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(F.col("__placed"), k + 1)["h"] == x["h"], F.lit(False)), x["i"]))
    step = step.select(*rest, F.sort_array(F.filter(same, lambda i: i.isNotNull())).alias("__at"))
    covered = F.aggregate(F.transform("__at", lambda i, k: F.least(F.lit(3), F.coalesce(F.get(F.col("__at"), k + 1) - i, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    long = lambda c: F.col(c).cast("long")
    part = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return step.select(
        *(F.col("__row").getField(c).alias(c) for c in names),
        F.struct(
            long("__n").alias("n_words"),
            long("__chars").alias("word_chars"),
            long("__symbols").alias("n_symbols"),
            long("__n_lines").alias("n_lines"),
            long("__dup_lines").alias("n_dup_lines"),
            F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
            long("__stop").alias("n_stop"),
            part("__chars", "__n").alias("mean_word_chars"),
            part("__symbols", "__n").alias("symbol_ratio"),
            part("__stop", "__n").alias("stop_ratio"),
            part("__dup_lines", "__n_lines").alias("dup_line_ratio"),
            part("__upper", "__chars").alias("upper_ratio"),
        ).alias("quality_measures"),
    )


def compiled(m: Column, thresholds=THRESHOLDS) -> Column:
    """Names of the rules that fail, as one expression over the measures."""
    out = []
    for name, ratio, low, high in thresholds:
        bad = F.lit(False)
        if low is not None:
            bad = bad | (m[ratio] < low)
        if high is not None:
            bad = bad | (m[ratio] > high)
        out.append(F.when(bad, F.lit(name)))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def judge_quality(df: DataFrame, text: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """Adds ``quality_measures``, ``base_failed``, ``failed_rules`` and ``kept`` (false if base_failed or a rule fails).

    base_failed: fewer than 50 words, or more than half of the words in repeated windows. Nothing is dropped.
    """
    out = measures(df.drop("base_failed", "failed_rules", "kept"), text)
    m = F.col("quality_measures")
    base = (m["n_words"] < 50) | (m["n_repeat_words"] * 100 > m["n_words"] * 50)
    out = out.withColumns({"base_failed": base, "failed_rules": compiled(m, thresholds)})
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
