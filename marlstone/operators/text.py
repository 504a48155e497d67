"""Sparse text features in long form (doc, term, weight), nearest texts by them, subword learning."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions.shared import written
from marlstone.operators.nearest import Grams, Weights, dealt, nearest
from marlstone.operators.order import prefix_sum


def _runs(parts: Column, lo: int, hi: int, join: str) -> Column:
    """Array of the runs of lo to hi neighbouring parts, shortest first.

    The parts are named once (as the one element of an array): as they stand they would be made anew for each run, in
    time that grows with the square of the text.
    """

    def of(xs: Column) -> Column:
        one = lambda n: F.transform(F.slice(xs, F.lit(1), F.greatest(F.size(xs) - (n - 1), F.lit(0))), lambda x, i: F.concat_ws(join, x, *(F.get(xs, i + k) for k in range(1, n))))
        return F.concat(*(one(n) for n in range(lo, hi + 1)))

    return F.flatten(F.transform(F.array(parts), of))


def char_ngrams(c: Column | str, lo: int, hi: int) -> Column:
    """Array of the text's character n-grams, shortest first; null counts as empty."""
    c = F.col(c) if isinstance(c, str) else c
    return _runs(F.filter(F.split(F.coalesce(c, F.lit("")), ""), lambda x: x != ""), lo, hi, "")


def token_ngrams(c: Column | str, lo: int = 1, hi: int = 1) -> Column:
    """Array of n-grams of the text's blank-separated tokens, joined by one blank; null counts as empty."""
    c = F.col(c) if isinstance(c, str) else c
    return _runs(F.filter(F.split(F.trim(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: w != ""), lo, hi, " ")


def counted(terms: Column) -> Column:
    """Array of (term, tf) of an array of terms, by term: the array is sorted and its runs are measured, within the row."""

    def of(xs: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(1), F.greatest(F.size(xs), F.lit(1))), lambda i: (i <= F.size(xs)) & ((i >= F.size(xs)) | (F.get(xs, i - 1) != F.get(xs, i))))
        runs = F.transform(F.array(ends), lambda e: F.transform(e, lambda x, k: F.struct(F.get(xs, x - 1).alias("term"), (x - F.coalesce(F.get(e, k - 1), F.lit(0))).cast("long").alias("tf"))))
        return F.flatten(runs)

    return F.flatten(F.transform(F.array(F.sort_array(terms)), of))


def term_counts(df: DataFrame, key: str, terms: Column, unique: bool = False) -> DataFrame:
    """key, term, tf. Terms are counted within each row first; ``unique`` (each key in one row) then needs no shuffle."""
    rows = df.select(key, F.explode(counted(terms)).alias("t")).select(key, "t.term", "t.tf")
    return rows if unique else rows.groupBy(key, "term").agg(F.sum("tf").alias("tf"))


def fit_vocabulary(counts: DataFrame, min_df: int = 2, max_features: int | None = None) -> DataFrame:
    """term, df, total: terms of at least ``min_df`` documents; the most frequent (ties by term) if capped."""
    vocab = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).where(F.col("df") >= min_df)
    return vocab.orderBy(F.desc("total"), "term").limit(max_features) if max_features else vocab


def tfidf(counts: DataFrame, vocab: DataFrame, n_docs: DataFrame, key: str, sublinear: bool = True, normalize: bool = True) -> DataFrame:
    """key, term, weight: tf (1 + ln tf) times ln((1 + n)/(1 + df)) + 1, rows of length 1; unknown terms are left out.

    n_docs: one row with column n. The vocabulary comes from the training rows only.
    """
    tf = 1 + F.log("tf") if sublinear else F.col("tf").cast("double")
    rows = counts.join(vocab.select("term", "df"), "term").crossJoin(F.broadcast(n_docs.select("n")))
    rows = rows.select(key, "term", (tf * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("weight"))
    return unit_rows(rows, key) if normalize else rows


def unit_rows(rows: DataFrame, key: str) -> DataFrame:
    """key, term, weight with weights scaled to length 1 for each key: a key's terms are gathered once, not sorted."""
    square = F.sum(F.col("weight") * F.col("weight"))
    whole = rows.groupBy(key).agg(F.collect_list(F.struct("term", "weight")).alias("__t"), F.sqrt(square).alias("__n"))
    return whole.select(key, "__n", F.explode("__t").alias("__t")).select(key, "__t.term", (F.col("__t.weight") / F.col("__n")).alias("weight"))


def count_vectors(counts: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    """key, term, weight: counts of known terms, rows of length 1."""
    return unit_rows(counts.join(vocab.select("term"), "term").select(key, "term", F.col("tf").cast("double").alias("weight")), key)


def encode_chars(df: DataFrame, c: str, vocab: DataFrame, n: int, name: str = "codes") -> DataFrame:
    """Adds n codes (0 pad, 1 unknown, then the vocabulary's), n_truncated and n_unknown.

    vocab: char, code (codes from 2), fitted on training rows; characters of an alphabet, so it travels as one map.
    """
    table = vocab.agg(F.map_from_entries(F.collect_list(F.struct("char", F.col("code").cast("int").alias("code")))).alias("__map"))
    chars = F.split(F.coalesce(F.col(c), F.lit("")), "")
    chars = F.filter(chars, lambda x: x != "")
    codes = F.transform(F.slice(chars, 1, n), lambda x: F.coalesce(F.try_element_at("__map", x), F.lit(1)))
    out = df.crossJoin(F.broadcast(table)).withColumn("__c", codes)
    return out.withColumns({name: F.concat("__c", F.array_repeat(F.lit(0), F.lit(n) - F.size("__c"))), "n_truncated": F.greatest(F.size(chars) - n, F.lit(0)), "n_unknown": F.size(F.filter("__c", lambda x: x == 1))}).drop("__c", "__map")


def char_vocabulary(df: DataFrame, c: str) -> DataFrame:
    """char, code: characters of the given (training) rows in order, from 2."""
    chars = df.select(F.explode(F.split(c, "")).alias("char")).where("char <> ''").distinct()
    return chars.withColumn("code", F.row_number().over(Window.orderBy("char")) + 1)  # one row a character


def nearest_similarity(query: DataFrame, ref: DataFrame, key: str, c: str, n: int = 3, max_features: int = 8192, others: bool = False, exact: bool = True, rank: int = 1536, block: int = 512, part: int = 8192) -> DataFrame:
    """key, similarity, nearest, multiplied: 1 for a text that occurs in ``ref``, else the largest cosine of L2 TF-IDF n-grams.

    The vocabulary is the ``max_features`` most frequent n-grams of ``ref``. others: the query's rows are rows of ``ref``
    too, and a row is not its own neighbour. Texts that do not occur in ``ref`` are held against all of it by an upper bound
    on each pair (see ``nearest``); ``multiplied`` counts the pairs that it left open. exact=False verifies a
    few partners of each part only. ``nearest`` is the smallest reference key of the largest cosine (to 9 places). Null and empty texts
    and texts without a known n-gram have similarity 0. Texts are told apart by their SHA-256 and travel as their grams.
    """
    grams = Grams(n)
    rows = grams.rows(ref.select(F.col(key).alias("ref_key"), F.col(c).alias("text")), "ref_key", "text")
    if same := others and query.sameSemantics(ref):
        rows = written(rows)  # the queries too
    texts = written(rows.where("digest is not null").groupBy("digest").agg(F.min("ref_key").alias("ref_key"), F.max("ref_key").alias("last_key"), F.count("*").alias("copies"), F.any_value("grams").alias("grams")))
    total = texts.count()
    vocab, df = grams.vocabulary(texts, max_features)
    weights = Weights(grams, vocab, np.log((1 + total) / (1 + df)) + 1)
    vectors = dealt(weights.vectors(texts.select("ref_key", "copies", "grams")), 2048)
    if same:
        asked = rows.select(F.col("ref_key").alias("query_key"), "digest")
    else:
        asked = grams.rows(query.select(F.col(key).alias("query_key"), F.col(c).alias("text")), "query_key", "text")
        asked = asked.drop("grams") if others else asked
    asked = written(asked.join(texts.drop("grams"), "digest", "left"))
    there = (F.coalesce("copies", F.lit(0)) > 1) if others else F.col("ref_key").isNotNull()
    if same:
        left = vectors.where("copies = 1").select(F.col("ref_key").alias("query_key"), F.col("ref_key").alias("own"), "terms", "norm")
    elif others:
        left = asked.where(~there).select("query_key", F.col("ref_key").alias("own")).join(vectors.select(F.col("ref_key").alias("own"), "terms", "norm"), "own").select("query_key", "own", "terms", "norm")
    else:
        left = weights.vectors(asked.where(~there & F.col("digest").isNotNull()).select("query_key", F.lit(None).cast("long").alias("own"), "grams"))
    found = nearest(left, vectors, weights, exact, rank, block, part)
    twin = F.when(F.col("ref_key") == F.col("query_key"), F.col("last_key")).otherwise(F.col("ref_key")) if others else F.col("ref_key")
    out = asked.join(found, "query_key", "left")
    return out.select(F.col("query_key").alias(key), F.when(there, 1.0).otherwise(F.least(F.lit(1.0), F.coalesce("cosine", F.lit(0.0)))).alias("similarity"), F.when(there, twin).otherwise(F.col("nearest")).alias("nearest"), F.coalesce("multiplied", F.lit(0)).cast("long").alias("multiplied"))


def _joined(parts: list[str], taken: dict[tuple[str, str], str]) -> list[str]:
    """The parts with the taken pairs joined from left to right; no two of them have a symbol in common."""
    out, k = [], 0
    while k < len(parts):
        made = taken.get((parts[k], parts[k + 1])) if k + 1 < len(parts) else None
        out.append(made or parts[k])
        k += 2 if made else 1
    return out


def _pairs(parts: Column) -> Column:
    """Array of neighbouring parts as structs a, b."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(parts) - 2, F.lit(0))), lambda i: F.struct(F.get(parts, i).alias("a"), F.get(parts, i + 1).alias("b")))


def take_in_order(top: list[tuple[str, str, int]], whole: bool, most: int) -> list[tuple[str, str]]:
    """How far pairs, given by falling count and then by name, can be merged at once as if one by one.

    A merge changes only pairs that share a symbol with it, and a pair that it makes is at most as frequent as such a pair.
    So the next one is taken as long as no other pair of its count or more shares a symbol with what was taken. whole: there
    are no pairs beyond ``top``; else a pair of the last count may be missing.
    """
    taken: list[tuple[str, str]] = []
    used: set[str] = set()
    for a, b, n in top:
        if len(taken) >= most or {a, b} & used or (taken and not whole and n <= top[-1][2]):
            break
        if any(m >= n and {c, d} & used and (c, d) not in taken for c, d, m in top):
            break
        taken.append((a, b))
        used |= {a, b}
        if a == b:  # it may make neighbours of its own making
            break
    return taken


def learn_subwords(df: DataFrame, c: str, merges: int = 50, per_pass: int = 10) -> list[tuple[str, str]]:
    """Merge list by repeatedly joining the most frequent neighbouring symbols (ties: by name), at most ``merges``.

    Works on distinct words with counts. Pair counts are kept as a table: a pass joins pairs in the words that hold them
    and adds what those words' pairs lost and gained, so nothing is counted anew. A pass takes up to ``per_pass`` merges, as
    far as their order is sure to be that of one merge at a time (see ``take_in_order``); the driver sees four times as
    many pairs. Pairs that occur once are not merged. Words carry their symbols as one text with blanks between.
    """
    words = df.select(F.explode(F.split(F.lower(c), r"\s+")).alias("w")).where("w <> ''").groupBy("w").agg(F.count("*").alias("n"))
    symbols = written(words.select("n", F.array_join(F.filter(F.split("w", ""), lambda x: x != ""), " ").alias("s"), F.lit(None).cast("string").alias("old")))
    counted_ = lambda rows, s, sign: rows.select((F.col("n") * sign).alias("n"), F.explode(_pairs(F.split(s, " "))).alias("p")).where("p.b is not null").select("p.a", "p.b", "n")
    pairs = written(counted_(symbols, "s", 1).groupBy("a", "b").agg(F.sum("n").alias("n")))
    done: list[tuple[str, str]] = []
    while len(done) < merges:
        top = [tuple(r) for r in pairs.where("n > 1").orderBy(F.desc("n"), "a", "b").limit(4 * per_pass + 1).collect()]
        taken = take_in_order(top[: 4 * per_pass], len(top) <= 4 * per_pass, min(per_pass, merges - len(done)))
        if not taken:
            break
        made = {(a, b): a + b for a, b in taken}

        def join(batches, made=made):
            for batch in batches:
                olds, news = batch.column(1).to_pylist(), []
                for s in olds:
                    parts = s.split(" ")
                    new = _joined(parts, made)
                    news.append(" ".join(new) if len(new) < len(parts) else None)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n or s for n, s in zip(news, olds, strict=True)]), pa.array([s if n else None for n, s in zip(news, olds, strict=True)], pa.string())], names=["n", "s", "old"])

        symbols = written(symbols.select("n", "s").mapInArrow(join, "n long, s string, old string"))
        changed = symbols.where("old is not null")
        moved = counted_(changed, "old", -1).unionByName(counted_(changed, "s", 1))
        pairs = written(pairs.unionByName(moved).groupBy("a", "b").agg(F.sum("n").alias("n")).where("n > 0"))
        done += taken
    return done


def merged(word: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """The word's symbols after all merges, each in its turn."""
    parts, last = list(word), -1
    while True:
        found = [r for x in zip(parts[:-1], parts[1:], strict=True) if (r := ranks.get(x, -1)) > last]
        if not found:
            return parts
        last, out = min(found), []
        for s in parts:
            if out and ranks.get((out[-1], s)) == last:
                out[-1] += s
            else:
                out.append(s)
        parts = out


def apply_subwords(df: DataFrame, c: str, merges: Sequence[tuple[str, str]], name: str = "subwords") -> DataFrame:
    """Adds the array of the subwords of a text's words, by the merge list; null counts as empty.

    Words met before are looked up in a table of each task, emptied beyond 100,000 words.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.StringType()))])
    at, ranks = df.columns.index(c), {x: k for k, x in enumerate(merges)}

    def run(batches):
        known: dict[str, list[str]] = {}
        for batch in batches:
            rows = []
            for text in batch.column(at).to_pylist():
                out = []
                for w in (text or "").lower().split():
                    if w not in known:
                        if len(known) > 100_000:
                            known.clear()
                        known[w] = merged(w, ranks)
                    out += known[w]
                rows.append(out)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(pa.string()))], names=schema.names)

    return df.mapInArrow(run, schema)


def ordered_terms(vocab: DataFrame) -> DataFrame:
    """term and index (from 0, in the terms' order) of a vocabulary of any size."""
    return prefix_sum(vocab.select("term", F.lit(1).alias("one")), ["term"], ["one"]).select("term", F.col("before_one").cast("long").alias("index"))


def sparse_rows(df: DataFrame, key: str, texts: Sequence[tuple[DataFrame, DataFrame]] = (), one_hot: Sequence[tuple[str, Sequence[str]]] = (), numbers: Sequence[str] = ()) -> DataFrame:
    """key, index, value: the non-zero features of each row, block after block, in long form; nothing has the full width.

    texts: (key, term, weight) with its vocabulary (term), each a block in the terms' order; one_hot: (column, its values), an
    unknown or null value is all zeros; numbers: columns of df, null and NaN count as 0. Keys are unique in df; rows of a text
    block whose key is not in df are left out.
    """
    out, base = None, 0
    for rows, vocab in texts:
        index = written(ordered_terms(vocab))
        found = rows.join(index, "term").where("weight <> 0").join(df.select(key), key, "left_semi")
        part = found.select(key, (F.col("index") + base).alias("index"), F.col("weight").cast("double").alias("value"))
        out, base = part if out is None else out.unionByName(part), base + index.count()
    cells = []
    for c, values in one_hot:
        at = F.array_position(F.array(*map(F.lit, values)), F.col(c))
        cells.append(F.when(at > 0, F.struct((at - 1 + base).cast("long").alias("index"), F.lit(1.0).alias("value"))))
        base += len(values)
    for k, c in enumerate(numbers):
        v = F.col(c).cast("double")
        cells.append(F.when(v.isNotNull() & ~F.isnan(v) & (v != 0), F.struct(F.lit(base + k).cast("long").alias("index"), v.alias("value"))))
    if cells:
        part = df.select(key, F.explode(F.filter(F.array(*cells), lambda x: x.isNotNull())).alias("x")).select(key, "x.index", "x.value")
        out = part if out is None else out.unionByName(part)
    return out


def packed_rows(df: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """df with indices and values (arrays by ascending index) of its sparse features; a row without any has empty arrays."""
    lists = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("index", "value"))).alias("__x"))
    out = df.join(lists, key, "left").withColumn("__x", F.coalesce("__x", F.array().cast(lists.schema["__x"].dataType)))
    return out.withColumns({"indices": F.transform("__x", lambda x: x["index"]), "values": F.transform("__x", lambda x: x["value"])}).drop("__x")
