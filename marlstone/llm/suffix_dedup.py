"""Exact repeats across documents by suffix arrays: bytes covered by a string that a document with a smaller id holds too.

Every window of ``length`` bytes belongs to the rarest-looking gram in it (the one of smallest hash), so that equal windows
meet: runs of windows with one gram are short strings, dealt to shards by the gram's hash. Grams that one document alone
holds are dropped first; they can have no repeats elsewhere. Each shard builds the suffix array of its distinct strings by
induced sorting and the common prefixes of neighbours in text order; neighbours that share ``length`` bytes
are one group, whose smallest document keeps it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import freed, join_hot, mix, release, rolling, slices, staged, text_array

#: Bytes of a gram, of text that is hashed at once, of strings in a shard; windows of one string at most.
GRAM, CHUNK, SHARD, RUN = 24, 1 << 17, 1 << 20, 64
#: Distinct strings of one gram beyond which its windows are dealt one by one.
CROWD = 20_000
#: Documents of the sample that tells frequent grams, grams told at most, and documents of the sample that hold one at least.
SAMPLE, FREQUENT, SEEN = 4096, 1024, 24


# --- suffix arrays ---------------------------------------------------------------------------------------------------


def _ascending(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one after it; the last one is not (an end marker follows it)."""
    n = len(text)
    out = np.zeros(n, bool)
    if n > 1:
        differs = np.where(text[:-1] != text[1:], np.arange(n - 1), n - 1)
        rising = np.append(text[:-1] < text[1:], False)
        out[:-1] = rising[np.minimum.accumulate(differs[::-1])[::-1]]
    return out


def _within(sorted_keys: np.ndarray) -> np.ndarray:
    """Rank of each element among its equals."""
    starts = np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))
    return np.arange(len(sorted_keys)) - np.repeat(starts, np.diff(np.append(starts, len(sorted_keys))))


def _deal(text, found, wanted, slots, fronts, count) -> None:
    """Puts the suffixes before ``found``, as far as ``wanted``, at the fronts of their letters' slots, in order.

    wanted: by suffix, with a False more at the end, for the one before the first. count: 0, 1, 2 and so on.
    """
    before = found - 1
    before = before[wanted[before]]
    if len(before):
        letters = text[before]
        order = letters.argsort(kind="stable")
        letters = letters[order]
        cuts = (letters[1:] != letters[:-1]).nonzero()[0] + 1
        bounds = np.empty(len(cuts) + 2, np.int64)
        bounds[0], bounds[1:-1], bounds[-1] = 0, cuts, len(letters)
        starts, sizes = bounds[:-1], bounds[1:] - bounds[:-1]
        firsts = letters[starts]
        slots[(fronts[firsts] - starts).repeat(sizes) + count[: len(letters)]] = before[order]
        fronts[firsts] += sizes


def _free(slots: np.ndarray, at: int, size: int) -> int:
    """The first place from ``at`` on that is not filled yet."""
    while at < len(slots):
        part = slots[at : at + size] < 0
        k = int(part.argmax())
        if part[k]:
            return at + k
        at, size = at + len(part), size * 2
    return len(slots)


def _induce(text: np.ndarray, size: int, rising: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """All suffixes, sorted from the sorted leftmost rising ones (``seeds``).

    One sweep forward places the falling suffixes, one backward the rising ones; a sweep takes at once all that
    stands filled before the next free place, in linear time over all.
    """
    n = len(text)
    count = np.arange(n, dtype=np.int32)
    up, down = np.append(rising, False), np.append(~rising, False)
    falling = np.bincount(text[~rising], minlength=size)
    seeded = np.bincount(text[seeds], minlength=size)
    fronts = np.cumsum(falling + seeded) - falling - seeded
    slots = np.full(n - int(rising.sum()) + len(seeds), -1, np.int32)
    if len(seeds):
        letters = text[seeds]
        slots[(fronts + falling)[letters] + _within(letters)] = seeds
    slots[fronts[text[n - 1]]] = n - 1
    fronts[text[n - 1]] += 1
    at, taken = 0, 256
    while at < len(slots):
        end = _free(slots, at, taken)
        _deal(text, slots[at:end], down, slots, fronts, count)
        at, taken = end, max(256, end - at)
    sorted_falling = slots[down[slots]]
    counts = falling + np.bincount(text[rising], minlength=size)
    starts = np.cumsum(counts) - counts
    # the second sweep runs backward: slots and places are mirrored
    slots = np.full(n, -1, np.int32)
    letters = text[sorted_falling]
    slots[n - 1 - (starts[letters] + _within(letters))] = sorted_falling
    fronts = n - (starts + counts)
    at, taken = 0, 256
    while at < n:
        end = _free(slots, at, taken)
        _deal(text, slots[at:end], up, slots, fronts, count)
        at, taken = end, max(256, end - at)
    return slots[::-1]


def _named(text: np.ndarray, size: int, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(seeds sorted by their substrings, whether each has the same as the one after it).

    A substring goes to the next seed, itself included, the last one to the end marker. Letters are packed into words of 64
    bits. A substring that begins another is the larger one: where it ends the other one falls, so the words are filled up
    with a letter above all; the end marker is below all.
    """
    n, bits = len(text), int(size + 1).bit_length()
    per, above = 64 // bits, np.uint64((1 << bits) - 1)
    lengths = np.diff(seeds, append=n) + 1

    def word(which: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros(len(which), np.uint64)
        for j in range(k * per, (k + 1) * per):
            at = which + j
            letter = np.where(at < n, text[np.minimum(at, n - 1)].astype(np.uint64) + np.uint64(1), np.uint64(0))
            out = (out << np.uint64(bits)) | np.where(sizes > j, letter, above)
        return out

    first = word(seeds, lengths, 0)
    order = np.argsort(first, kind="stable")
    first = first[order]
    same = first[:-1] == first[1:]
    group = np.concatenate(([0], np.cumsum(~same)))
    long = np.zeros(int(group[-1]) + 1, bool)
    long[group[lengths[order] > per]] = True
    spots = np.flatnonzero(long[group])
    if len(spots):  # whole groups, each a run of places in the order
        members = order[spots]
        sizes = lengths[members]
        words = [word(seeds[members], sizes, k) for k in range(1, -(-int(sizes.max()) // per))]
        inner = np.lexsort((*words[::-1], group[spots]))
        order[spots] = members[inner]
        equal = np.ones(len(spots) - 1, bool)
        for w in words:
            equal &= w[inner[:-1]] == w[inner[1:]]
        next_ = np.diff(spots) == 1
        same[spots[:-1][next_]] &= equal[next_]
    return seeds[order], same


def _doubled(names: np.ndarray) -> np.ndarray:
    """All suffixes of the names in order, by prefix doubling: what one, two, four ... names tell apart stays out of later rounds."""
    n = len(names)
    order = np.argsort(names, kind="stable")
    open_, key, old, reach = order, names[order].astype(np.int64), np.zeros(n, np.int64), 1
    rank = np.zeros(n, np.int64)  # place in the order of the first suffix that is not told apart from it yet
    while len(open_):
        place = np.arange(len(open_))
        first = np.concatenate(([True], key[1:] != key[:-1]))
        outer = np.concatenate(([True], old[1:] != old[:-1]))
        old = old + np.maximum.accumulate(np.where(first, place, 0)) - np.maximum.accumulate(np.where(outer, place, 0))
        rank[open_] = old
        alone = first & np.concatenate((first[1:], [True]))
        open_, old = open_[~alone], old[~alone]
        after = open_ + reach
        key = (old << 32) | np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        order = np.argsort(key)
        open_, key, old, reach = open_[order], key[order], old[order], reach * 2
    out = np.empty(n, np.int32)
    out[rank] = np.arange(n, dtype=np.int32)
    return out


def suffix_array(text: np.ndarray, size: int | None = None) -> np.ndarray:
    """Starts of all suffixes in order, a shorter one before what it begins. Letters are 0 to size - 1.

    Suffixes are rising or falling; the leftmost rising ones (seeds) cut the text into substrings, which are sorted and
    named; unless all names differ, the suffixes of the text of names are sorted by prefix doubling, and the order of the
    seeds induces that of all suffixes.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int32)
    size = size or int(text.max()) + 1
    text = text.astype(np.uint8 if size <= 1 << 8 else np.uint16 if size <= 1 << 16 else np.int32)
    rising = _ascending(text)
    left = np.zeros(n, bool)
    left[1:] = rising[1:] & ~rising[:-1]
    seeds = np.flatnonzero(left).astype(np.int32)
    if len(seeds) < 2:
        return _induce(text, size, rising, seeds)
    order, same = _named(text, size, seeds)
    names = np.concatenate(([0], np.cumsum(~same)))
    if names[-1] + 1 < len(seeds):
        named = np.zeros(n, np.int32)
        named[order] = names
        order = seeds[_doubled(named[seeds])]
    return _induce(text, size, rising, order)


def common_prefixes(data: np.ndarray, suffixes: np.ndarray, wanted: np.ndarray, most: int) -> np.ndarray:
    """By place in ``data`` (permuted order): bytes shared with the suffix that stands before in ``suffixes``, ``most`` at most.

    Only ``wanted`` places are worked off, 0 elsewhere; eight bytes are compared at a time.
    """
    n = len(data)
    before = np.full(n, -1, np.int32)
    before[suffixes[1:]] = suffixes[:-1]
    padded = np.concatenate((data, np.zeros(most + 16, np.uint8)))
    words = np.ndarray((n + most + 8,), "<u8", padded, strides=(1,))
    out = np.zeros(n, np.int64)
    at = np.flatnonzero(wanted & (before >= 0))
    for k in range(0, most, 8):
        differ = words[at + k] ^ words[before[at] + k]
        out[at] += np.where(differ == 0, 8, np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)) >> 3)
        at = at[differ == 0]
    return np.minimum(out, most)


def repeats(strings: list[bytes], smallest: np.ndarray, largest: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(string, first window, last window + 1, document) of runs of windows that a document before the string's largest
    holds; document: the smallest of all strings that hold the window. smallest, largest: documents of each string."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    data = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
    begins = np.cumsum(sizes + 1) - sizes - 1
    owner = np.repeat(np.arange(len(strings), dtype=np.int32), sizes + 1)
    letters = np.bincount(data, minlength=256) > 0
    rank = np.cumsum(letters)  # the letters that occur, by rank from 1; the ends of strings are 0
    text = rank.astype(np.uint16)[data]
    text[begins + sizes] = 0
    suffixes = suffix_array(text, int(rank[-1]) + 1)
    whole = (begins + sizes)[owner] - np.arange(len(data)) >= length
    shared = common_prefixes(data, suffixes, whole, length) >= length
    before = np.concatenate(([False], whole[suffixes[:-1]]))
    kept = whole[suffixes]
    places, joined = suffixes[kept], (shared[suffixes] & before)[kept]
    if not len(places):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    starts = np.flatnonzero(~joined)
    first = np.repeat(np.minimum.reduceat(smallest[owner[places]], starts), np.diff(np.append(starts, len(places))))
    least = np.zeros(len(data), np.int64)
    least[places] = first
    at = np.flatnonzero(whole & (least < largest[owner]))
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    new = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]]) | (least[at[1:]] != least[at[:-1]])))
    begin, end = at[new], at[np.concatenate((new[1:], [True]))] + 1
    return owner[begin], begin - begins[owner[begin]], end - begins[owner[begin]], least[begin]


# --- windows by gram -------------------------------------------------------------------------------------------------


def window_runs(data: np.ndarray, bounds: np.ndarray, length: int):
    """(place of the first window, number of windows, hash of their gram) of runs, for texts bounds[k]:bounds[k + 1]."""
    grams = length - GRAM + 1
    found = []
    for c in range(0, max(len(data) - length + 1, 0), CHUNK):
        part = data[c : c + CHUNK + length - 1]
        least = rolling(part, GRAM)
        reach = 1
        while reach < grams:  # least hash of the first 1, 2, 4 ... grams of each window
            step = min(reach, grams - reach)
            least = np.minimum(least[:-step], least[step:])
            reach += step
        first = np.searchsorted(bounds, [c, c + len(part)], "right")
        inner = bounds[first[0] : first[1]] - c
        whole = np.ones(len(least) + 1, bool)
        gone = np.zeros(len(least) + 1, np.int32)
        np.add.at(gone, np.clip(inner - length + 1, 0, len(least)), 1)
        np.add.at(gone, np.clip(inner, 0, len(least)), -1)
        whole = np.cumsum(gone)[:-1] == 0  # no text ends within the window
        edge = np.ones(len(least), bool)
        edge[1:] = (least[1:] != least[:-1]) | (whole[1:] != whole[:-1])
        edge[inner[(inner < len(least)) & (inner >= 0)]] = True
        starts = np.flatnonzero(edge)
        sizes = np.diff(np.append(starts, len(least)))
        starts, sizes = starts[whole[starts]], sizes[whole[starts]]
        cuts, until = -(-sizes // RUN), starts + sizes
        starts = np.repeat(starts, cuts) + RUN * (np.arange(int(cuts.sum())) - np.repeat(np.cumsum(cuts) - cuts, cuts))
        ends = np.minimum(starts + RUN, np.repeat(until, cuts))
        found.append((starts + c, ends - starts, least[starts]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = text_array(column, lower=False)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _grams(docs: DataFrame, length: int, without: np.ndarray) -> DataFrame:
    """gram and doc_id: each document's grams once, but for those in ``without``."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                data, bounds = _flat(part.column(1))
                at, _, grams = window_runs(data, bounds, length)
                owner = np.searchsorted(bounds, at, "right") - 1
                rows = ~np.isin(grams, without)
                owner, grams = owner[rows], grams[rows]
                order = np.lexsort((grams, owner))
                owner, grams = owner[order], grams[order]
                new = np.ones(len(order), bool)
                new[1:] = (owner[1:] != owner[:-1]) | (grams[1:] != grams[:-1])
                ids = part.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(grams[new].view(np.int64)), pa.array(ids[owner[new]], pa.int64())], names=["gram", "doc_id"])
        release()

    return docs.select("doc_id", "text").mapInArrow(run, "gram long, doc_id long")


def _strings(docs: DataFrame, length: int, frequent: np.ndarray) -> DataFrame:
    """gram, string, doc_id, tie and at: runs of windows of the grams that ``grams`` (of the row) or ``frequent`` hold."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                data, bounds = _flat(part.column(1))
                at, n, grams = window_runs(data, bounds, length)
                owner = np.searchsorted(bounds, at, "right") - 1
                lists = part.column(3)
                known = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                held = np.repeat(np.arange(part.num_rows, dtype=np.uint64), np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
                both = lambda o, g: mix(g ^ mix(o + np.uint64(1)))
                rows = np.isin(both(owner.astype(np.uint64), grams), both(held, known)) | np.isin(grams, frequent)
                at, n, grams, owner = at[rows], n[rows], grams[rows], owner[rows]
                raw = data.tobytes()
                strings = [raw[a:e] for a, e in zip(at.tolist(), (at + n + length - 1).tolist(), strict=True)]
                ids, ties = (part.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
                columns = [pa.array(grams.view(np.int64)), pa.array(strings, pa.binary()), pa.array(ids[owner], pa.int64()), pa.array(ties[owner], pa.int64()), pa.array(at - bounds[owner])]
                yield pa.RecordBatch.from_arrays(columns, names=["gram", "string", "doc_id", "tie", "at"])
        release()

    return docs.select("doc_id", "text", "tie", "grams").mapInArrow(run, "gram long, string binary, doc_id long, tie long, at long")


def _frequent(docs: DataFrame, length: int) -> np.ndarray:
    """Grams that SEEN documents of a sample hold, the FREQUENT most common at most: they certainly repeat, so their
    documents need not be gathered to find that out. Others are counted over all documents."""
    share = max(1, docs.count() // SAMPLE)
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0)
    found = _grams(some, length, np.zeros(0, np.uint64)).groupBy("gram").agg(F.countDistinct("doc_id").alias("n")).where(F.col("n") >= SEEN)
    return np.array([r.gram for r in found.orderBy(F.desc("n"), "gram").limit(FREQUENT).collect()], np.int64).view(np.uint64)


def _windows_apart(rows: DataFrame, length: int, at: bool) -> DataFrame:
    """Each window a string of its own, dealt by its own hash."""
    single = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.length("string") - length)))
    single = single.withColumn("string", F.expr(f"substring(string, k + 1, {length})")).withColumn("gram", F.xxhash64("string", F.lit(1)))
    return (single.withColumn("at", F.col("at") + F.col("k")) if at else single).drop("k")


def _shard_repeats(strings: DataFrame, length: int) -> DataFrame:
    """gram, hash, rows and runs (first and last window + 1, document) of the strings that hold windows found before."""
    size = strings.agg(F.coalesce(F.sum(F.length("string")), F.lit(0))).first()[0]
    shards = max(1, -(-size // SHARD))
    dealt = strings.select(F.pmod("gram", F.lit(shards)).alias("shard"), "gram", F.xxhash64("string").alias("hash"), "string", "lo", "hi", "rows")
    run_type = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("doc", pa.int64())]))

    def find(table: pa.Table) -> pa.Table:
        names = ["gram", "hash", "rows", "runs"]
        column = lambda c: table.column(c).to_numpy()
        owner, first, last, doc = repeats(table.column("string").to_pylist(), column("lo"), column("hi"), length)
        held, counts = np.unique(owner, return_counts=True)
        offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
        runs = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(doc)], names=["first", "last", "doc"]))
        out = pa.table([*(pa.array(column(c)[held]) for c in names[:3]), runs.cast(run_type)], names=names)
        release()
        return out

    return dealt.groupBy("shard").applyInArrow(find, "gram long, hash long, rows long, runs array<struct<first:int,last:int,doc:long>>")


def repeated_spans(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, tie (hash of the text) and spans (start and end in bytes, unordered, overlapping): what repeats.

    ``docs``: doc_id (long, not null) and text.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).where(F.octet_length("text") >= length)
    frequent = _frequent(docs, length)
    everyone = Window.partitionBy("gram")
    met = _grams(docs, length, frequent).select("doc_id", "gram", F.min("doc_id").over(everyone).alias("lo"), F.max("doc_id").over(everyone).alias("hi")).where("lo < hi")
    known = freed(met.groupBy("doc_id").agg(F.collect_list("gram").alias("grams")), "grams")
    found = freed(_strings(docs.join(known, "doc_id", "left"), length, frequent), "strings")
    grouped = lambda rows: rows.groupBy("gram", "string").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("rows").alias("rows"))
    strings = freed(grouped(found.select("gram", "string", F.col("doc_id").alias("lo"), F.col("doc_id").alias("hi"), F.lit(1).cast("long").alias("rows"))), "distinct")
    crowded = staged(strings.groupBy("gram").count().where(F.col("count") > CROWD).select("gram"), "crowded")
    if not crowded.isEmpty():  # one gram in very many surroundings: its windows are dealt one by one
        apart = _windows_apart(strings.join(crowded, "gram", "left_semi"), length, at=False)
        strings = strings.join(crowded, "gram", "left_anti").unionByName(grouped(apart))
        found = found.join(crowded, "gram", "left_anti").unionByName(_windows_apart(found.join(crowded, "gram", "left_semi"), length, at=True))
    runs = freed(_shard_repeats(strings, length), "runs")
    places = found.select("gram", F.xxhash64("string").alias("hash"), "doc_id", "tie", "at")
    spans = join_hot(places, runs, ["gram", "hash"], "rows", runs.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0])
    spans = spans.select("doc_id", "tie", "at", F.explode("runs").alias("run")).where("run.doc < doc_id")
    spans = spans.select("doc_id", "tie", F.struct((F.col("at") + F.col("run.first")).alias("start"), (F.col("at") + F.col("run.last") + (length - 1)).alias("end")).alias("span"))
    return freed(spans.groupBy("doc_id", "tie").agg(F.collect_list("span").alias("spans")), "spans")


def remove_repeats(df: DataFrame, length: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds n_bytes, n_removed, removed (maximal spans of bytes, start and end) and kept (binary: the other bytes, joined).

    A byte of a text (UTF-8; null is empty) is removed if a string of ``length`` bytes that covers it also stands in a text
    with a smaller id. Rows without id neither lose nor take anything; rows that share an id do not take from one another.
    Texts shorter than ``length`` stay. Columns of the same names are replaced, others kept; no rows give no rows.
    """
    names = ["n_bytes", "n_removed", "removed", "kept"]
    keep = [c for c in df.columns if c not in names]
    df = df.select(*(F.col(f"`{c}`") for c in keep))
    spans = repeated_spans(df.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), length)
    spans = spans.select(F.col("doc_id").alias("__id"), F.col("tie").alias("__tie"), F.col("spans").alias("__spans"))
    joined = df.join(spans, (F.col(f"`{doc_id}`").cast("long") == F.col("__id")) & (F.xxhash64(F.col(f"`{text}`")) == F.col("__tie")), "left").select(*(F.col(f"`{c}`") for c in keep), "__spans")
    added = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept", T.BinaryType())]
    schema, at = T.StructType([*df.schema.fields, *added]), keep.index(text)
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(raw: bytes, spans: pa.StructArray | None) -> tuple[list[dict], bytes]:
        if spans is None or not len(spans):
            return [], raw
        start, end = (spans.field(k).to_numpy() for k in (0, 1))
        order = np.argsort(start)
        start, end = start[order], np.maximum.accumulate(end[order])
        new = np.concatenate(([True], start[1:] > end[:-1]))
        start, end = start[new], end[np.concatenate((new[1:], [True]))]
        kept = b"".join(raw[a:b] for a, b in zip([0, *end.tolist()], [*start.tolist(), len(raw)], strict=True))
        return [{"start": a, "end": b} for a, b in zip(start.tolist(), end.tolist(), strict=True)], kept

    def run(batches):
        for batch in batches:
            for part in slices(batch, at):
                data, bounds = _flat(part.column(at))
                raw, cuts = data.tobytes(), bounds.tolist()
                lists = part.column(len(keep))
                rows = [cut(raw[a:b], s.values if s.is_valid else None) for a, b, s in zip(cuts[:-1], cuts[1:], lists, strict=True)]
                size = np.diff(bounds)
                gone = size - np.fromiter((len(k) for _, k in rows), np.int64, len(rows))
                columns = [*part.columns[: len(keep)], pa.array(size), pa.array(gone), pa.array([r for r, _ in rows], span_type), pa.array([k for _, k in rows], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        release()

    return joined.mapInArrow(run, schema)
