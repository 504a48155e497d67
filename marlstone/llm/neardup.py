"""Near-duplicate classes: improved consistent weighted sampling over TF-IDF shingles, banded, verified.

A shingle is five words (lower case, ASCII marks left out); its weight is its count in the text times the mean
inverse document frequency of its words. Frequencies of words, not of shingles, so that copies do not lower the weight
of what they share; they are counted over all documents in a fixed number of hashed buckets.

1. Equal texts fall together by digest, which names them from here on; one of each stands for all.
2. Each text gets bands x rows samples, one row for each band's key.
3. A bucket (texts with one key) of up to ``SMALL`` texts gives all its pairs. A larger one gives its pairs with its
   first text (the hub), so that rows grow with the bucket's size and not with its square.
4. Pairs are verified: both texts' weighted sets, Jaccard = sum of minima / sum of maxima.
5. What a hub cannot decide: two members of its buckets may be alike though one is too far from the hub. For each
   member the weight shared with the hub and the weight shared with other members outside the hub (of a shingle that
   the hub has too: what exceeds the hub's weight) bound what it can share with anyone; nearly all are ruled out by that. The rest first meet in groups by a shingle they share outside
   the hub (again with that group's first text only), then those pairs that the bound allows and that are not joined
   yet are verified. So no pair that shares a bucket is left out unless it is joined already or below the threshold.
6. Connected components of the verified pairs are the classes.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import bucket_df, mix, release, shingles, slices, staged, text_array, word_blocks

BITS, SMALL = 16, 8
WORDS, BANDS, ROWS, THRESHOLD = 5, 12, 4, 0.8


def smooth_idf(df: np.ndarray, n: int) -> np.ndarray:
    return (1.0 + np.log((1.0 + n) / (1.0 + np.minimum(df, n)))).astype(np.float32)


def weighted_sets(texts: pa.Array, idf: np.ndarray, size: int = WORDS):
    """Yields (first, ids, weights, starts) for blocks of texts: sorted shingle ids of each text, and where each begins.

    starts has one entry more than the block has texts; a text without words has no shingle.
    """
    shift = np.uint64(64 - BITS)
    for first, last, hashes, counts, _, _ in word_blocks(texts):
        found, owner, at = shingles(hashes, counts, size)
        sums = np.concatenate(([0.0], np.cumsum(idf[(hashes >> shift).astype(np.int64)], dtype=np.float64)))
        ends = np.minimum(at + size, np.cumsum(counts)[owner]) if len(owner) else at
        mean = (sums[ends] - sums[at]) / np.maximum(ends - at, 1)
        keys = (owner.astype(np.uint64) << np.uint64(48)) | (found >> np.uint64(16))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        times = np.diff(np.append(heads, len(keys)))
        ids = keys[heads]
        starts = np.searchsorted(ids >> np.uint64(48), np.arange(last - first + 1, dtype=np.uint64))
        yield first, ids & np.uint64((1 << 48) - 1), (times * mean[order][heads]), starts


@lru_cache(1)
def _gamma2() -> tuple[np.ndarray, np.ndarray]:
    """65,536 quantiles of the gamma distribution with shape 2, and their logarithms."""
    u = (np.arange(65536) + 0.5) / 65536
    low, high = np.zeros(65536), np.full(65536, 40.0)
    for _ in range(60):
        x = (low + high) / 2
        above = 1 - (1 + x) * np.exp(-x) > u
        low, high = np.where(above, low, x), np.where(above, x, high)
    return x.astype(np.float32), np.log(x).astype(np.float32)


def consistent_samples(ids: np.ndarray, weights: np.ndarray, starts: np.ndarray, n: int, seed: int = 5) -> np.ndarray:
    """n samples (64-bit) of each non-empty weighted set; two sets share each with their weighted Jaccard as chance.

    Improved consistent weighted sampling: r and c are gamma(2, 1), b is uniform, t = floor(ln w / r + b), and the
    element with the smallest ln c - r (t - b + 1) is drawn, together with its t.
    """
    gamma, log_gamma = _gamma2()
    odd = np.random.default_rng(seed).integers(0, 2**63, (n, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    log_w, places = np.log(weights).astype(np.float32), np.arange(len(ids), dtype=np.uint64)
    out = np.empty((len(starts), n), np.uint64)
    for k in range(n):
        h = mix(ids * odd[k, 0] + odd[k, 1])
        r = gamma[h & np.uint64(0xFFFF)]
        b = ((h >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.float32) * np.float32(2**-16)
        t = np.floor(log_w / r + b)
        score = log_gamma[(h >> np.uint64(16)) & np.uint64(0xFFFF)] - r * (t - b + np.float32(1))
        bits = score.view(np.uint32)
        bits = np.where(bits >> 31, ~bits, bits | np.uint32(0x80000000))  # the floats' order, as unsigned integers
        best = np.minimum.reduceat((bits.astype(np.uint64) << np.uint64(32)) | places, starts) & np.uint64(0xFFFFFFFF)
        out[:, k] = mix(ids[best] * odd[k, 1] + t[best].astype(np.int64).view(np.uint64))
    return out


def band_keys(samples: np.ndarray, bands: int, rows: int) -> np.ndarray:
    odd = np.random.default_rng(3).integers(0, 2**63, (bands, rows + 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    grouped = samples.reshape(len(samples), bands, rows)
    return mix((grouped * odd[:, :rows]).sum(2, dtype=np.uint64) + odd[:, rows]).view(np.int64)


def digest_of(text: str) -> Column:
    """16 bytes that stand for a text (null: empty)."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def node_of(first: str, digest: str) -> Column:
    """24 bytes in the order of (doc_id, digest): a group's smallest id, mostly its origin, becomes its hubs."""
    place = F.lpad(F.hex(F.col(first).bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    return F.concat(F.unhex(place), F.col(digest))


def _signatures(df: DataFrame, idf: np.ndarray, bands: int, rows: int) -> DataFrame:
    kind = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        for whole in batches:
            for batch in slices(whole, 2):
                for first, ids, weights, starts in weighted_sets(text_array(batch.column(2)), idf):
                    full = np.flatnonzero(np.diff(starts))
                    keys = band_keys(consistent_samples(ids, weights, starts[full], bands * rows), bands, rows) if len(full) else np.zeros((0, bands), np.int64)
                    sizes = np.where(np.diff(starts) > 0, bands, 0)
                    cuts = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                    part = batch.slice(first, len(starts) - 1)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(cuts, keys.ravel())], schema=kind)
        release()

    return df.select("doc_id", digest_of("text").alias("digest"), "text").mapInArrow(run, "doc_id long, digest binary, bands array<long>")


def _verify(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, outside: bool = False) -> DataFrame:
    """a, b, similarity, shared, weight_a, weight_b of each pair; outside: also b's shingles that a lacks or has fewer times, with the weight that a lacks."""
    rows = pairs.select("a", "b").join(texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")
    names = ["a", "b", "similarity", "shared", "weight_a", "weight_b", "extra", "extra_weights"]

    def sets(column):
        out = []
        for _, ids, weights, starts in weighted_sets(text_array(column), idf):
            out += [(ids[i:j], weights[i:j]) for i, j in zip(starts[:-1], starts[1:], strict=True)]
        return out

    def run(batches):
        for whole in batches:
            for batch in slices(whole, 3, 1 << 20, 256):
                keys = batch.column(0).to_pylist()
                heads = [i for i, x in enumerate(keys) if not i or keys[i - 1] != x]
                firsts = sets(pa.chunked_array([batch.column(2).take(pa.array(heads))]))
                where = np.searchsorted(heads, np.arange(len(keys)), "right") - 1
                found = []
                for at, (ids, w) in zip(where, sets(pa.chunked_array([batch.column(3)])), strict=True):
                    base, v = firsts[at]
                    spot = np.minimum(np.searchsorted(base, ids), max(len(base) - 1, 0))
                    both = base[spot] == ids if len(base) else np.zeros(len(ids), bool)
                    shared = float(np.minimum(w[both], v[spot[both]]).sum()) if len(base) else 0.0
                    sum_a, sum_b = float(v.sum()), float(w.sum())
                    surplus = w.copy()
                    if len(base):
                        surplus[both] -= v[spot[both]]
                    rest = surplus > 0.5 if outside else np.zeros(len(ids), bool)  # one time more weighs 1 at least; less is rounding
                    found.append((shared / max(sum_a + sum_b - shared, 1e-12), shared, sum_a, sum_b, ids[rest].view(np.int64), surplus[rest]))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([f[c] for f in found], kind) for c, kind in enumerate([*[pa.float64()] * 4, pa.list_(pa.int64()), pa.list_(pa.float64())]))], names=names)
        release()

    return rows.mapInArrow(run, "a binary, b binary, similarity double, shared double, weight_a double, weight_b double, extra array<long>, extra_weights array<double>")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b); label is the smallest node joined with it.

    Labels spread to neighbours and are then followed one step (pointer jumping), each round written to the shared
    folder, until none changes; the driver sees one count a round.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("next")).union(edges.select("b", "a")).distinct()
    both = staged(both, "links")
    labels = staged(both.groupBy("node").agg(F.least(F.col("node"), F.min("next")).alias("label")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("next"), "label"), "next").groupBy("node").agg(F.min("label").alias("near"))
        spread = labels.join(seen, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = spread.join(labels.select(F.col("node").alias("label"), F.col("label").alias("further")), "label", "left")
        after = staged(jump.select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        labels = after.select("node", "label")
        if after.where(F.col("old") != F.col("label")).isEmpty():
            return labels


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class), texts (different texts in the class), similar (more than
    one), digest (of the text), class_key (digest of the class's first text, by doc_id)
    and chosen (the row's id and text stand for the class).

    One row for each row of ``df``. Null texts count as empty; texts without a word are alike only if equal. A row
    without doc_id takes the class of the texts equal to its own, or null, and is never chosen. Repeated rows are copies.
    Where several texts share a doc_id each is compared for itself; class_key tells classes apart that so have one
    class_id. Which pairs are verified depends on the order of ids and the sizes of
    buckets; the classes and ``texts`` do not. An empty table gives an empty table;
    other columns are left out. Texts below five words have one shingle of all their words; long texts are read whole.
    """
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    idf = smooth_idf(*bucket_df(docs, "text", BITS))
    signed = staged(_signatures(docs, idf, bands, rows), "signatures")
    reps = staged(signed.groupBy("digest").agg(F.min("doc_id").alias("first"), F.first("bands").alias("bands")), "distinct")
    members = reps.where(F.col("first").isNotNull()).select(node_of("first", "digest").alias("rep"), "first", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("size")).where("size > 1")
    placed = staged(members.join(buckets, "key"), "buckets")
    small = placed.where(F.col("size") <= SMALL).groupBy("key").agg(F.collect_list("rep").alias("m"))
    small = small.select(F.explode("m").alias("a"), "m").select("a", F.explode("m").alias("b")).where("a < b").distinct()
    hubs = placed.where((F.col("size") > SMALL) & (F.col("rep") > F.col("hub"))).select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    wanted = placed.select(F.col("first").alias("doc_id"), F.substring("rep", 9, 16).alias("digest"), "rep").distinct()
    texts = docs.withColumn("digest", digest_of("text")).join(wanted.hint("merge"), ["doc_id", "digest"])  # by both: a text's copies are not dealt to one task
    texts = staged(texts.dropDuplicates(["rep"]).select("rep", "text"), "texts")
    simple = staged(_verify(small, texts, idf).where(F.col("similarity") >= threshold).select("a", "b"), "pairs")
    starred = staged(_verify(hubs, texts, idf, outside=True), "stars")
    linked = simple.union(starred.where(F.col("similarity") >= threshold).select("a", "b"))

    # What hubs leave open: weight that members share with each other outside their hub.
    extra = starred.select("a", "b", F.explode(F.arrays_zip("extra", "extra_weights")).alias("x")).select("a", "b", F.col("x.extra").alias("shingle"), F.col("x.extra_weights").alias("w"))
    common = extra.groupBy("a", "shingle").agg(F.count("*").alias("n")).where("n > 1").select("a", "shingle")
    outside = extra.join(common, ["a", "shingle"]).groupBy("a", "b").agg(F.sum("w").alias("outside"), F.min(F.xxhash64("shingle")).alias("meet"))
    least = starred.groupBy("a").agg(F.min("weight_b").alias("lightest"))
    known = starred.select("a", "b", "similarity", "shared", "weight_b").join(outside, ["a", "b"], "left").join(least, "a")
    known = staged(known.withColumn("outside", F.coalesce("outside", F.lit(0.0))), "members")
    most = F.least(F.col("shared") + F.col("outside"), F.col("weight_b"))
    partner = F.greatest(F.col("lightest"), threshold * F.col("weight_b"), most)
    able = F.least(most / (F.col("weight_b") + partner - most), F.lit(1.0)) >= threshold - 1e-9
    open_ = staged(known.where((F.col("similarity") < threshold) & able), "open")
    if not open_.isEmpty():
        met = open_.where(F.col("meet").isNotNull())
        heads = met.groupBy("a", "meet").agg(F.min("b").alias("head"))
        again = met.join(heads, ["a", "meet"]).where("b > head").select(F.col("head").alias("a"), "b").distinct()
        linked = staged(linked.union(_verify(again, texts, idf).where(F.col("similarity") >= threshold).select("a", "b")).distinct(), "linked")
        labels = components(linked)
        label = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias(f"label_{side}"))
        side = lambda d, n: d.select("a", F.col("b").alias(n), *(F.col(c).alias(f"{c}_{n}") for c in ("shared", "outside", "weight_b"))).join(label(n), n, "left").withColumn(f"label_{n}", F.coalesce(f"label_{n}", n))
        bound = F.least("shared_f", "shared_m") + F.least("outside_f", "outside_m") >= threshold / (1 + threshold) * (F.col("weight_b_f") + F.col("weight_b_m")) - 1e-9
        rest = side(open_, "f").join(side(known, "m"), "a").where((F.col("label_f") != F.col("label_m")) & bound)
        rest = rest.select(F.least("f", "m").alias("a"), F.greatest("f", "m").alias("b")).distinct()
        linked = staged(linked.union(_verify(rest, texts, idf).where(F.col("similarity") >= threshold).select("a", "b")), "linked")
    linked = staged(linked.distinct(), "linked")
    named = components(linked).join(reps.where("first is not null").select(node_of("first", "digest").alias("node"), "first", "digest"), "node")
    heads = named.groupBy("label").agg(F.min(F.struct("first", "digest")).alias("head"), F.count("*").alias("texts"))
    nodes = named.join(heads, "label").select("digest", F.col("head")["first"].alias("class_id"), F.col("head")["digest"].alias("class_key"), "texts")
    classes = reps.select("digest", "first").join(nodes, "digest", "left").select("digest", F.coalesce("class_id", "first").alias("class_id"), F.coalesce("class_key", "digest").alias("class_key"), F.coalesce("texts", F.lit(1).cast("long")).alias("texts"))
    out = signed.select("doc_id", "digest").join(classes, "digest")
    chosen = F.coalesce((F.col("doc_id") == F.col("class_id")) & (F.col("digest") == F.col("class_key")), F.lit(False))
    return out.select("doc_id", "class_id", (F.col("texts") > 1).alias("similar"), "texts", "digest", "class_key", chosen.alias("chosen"))
