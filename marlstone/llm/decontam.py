"""Benchmark decontamination by latent semantic retrieval.

Passages are windows of 64 words, 32 apart; their TF-IDF vectors live in 2**14 hashed features. Randomised SVDs of
benchmark passages and all corpus passages give the latent spaces (inverse document frequencies are squared: frequent
words would make everything alike). One pass over the corpus adds each passage of each document, with a random sign, to
one of ``SKETCH`` rows (a random projection with one entry a passage); the power passes are Spark jobs over these rows
and the benchmark's. A space of fixed rank holds only so many items, so the benchmark's passages are dealt to blocks of
``PART``, each with a space of its own in which they outweigh the corpus: all of them lie in it almost whole, however
many items there are.

Every passage of every document is searched in every space: cosine with each item passage's latent vector, the
document passage's length taken in full but as at most ``LONGEST`` times the item's, so that a short item among rare
words is not drowned. There is no other source of candidates. Candidates are verified word by word: longest common
subsequence with the item, and a check of the item's answer (its rarest words), so that paraphrases count and chance
does not.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import bucket_df, release, slices, staged, text_array, word_blocks

BITS, STEP, RANK, EXTRA = 14, 32, 160, 16
#: Benchmark passages to a space; the rest of its rank is left to the corpus.
PART = 128
#: A document passage counts as at most so many times as long as the item passage it is compared with.
LONGEST = 3.0
SHIFT = np.uint64(64 - BITS)
#: Words whose vector is shorter than this part of the space's longest are left out of passages' sums, but for answer words.
LIVE = 0.03
#: Rows that all corpus passages are projected to, and features of a row that are added up at once.
SKETCH, CUT = 256, 4096


def passage_starts(count: int) -> list[int]:
    """First words of a text's passages: every STEP words, the last one reaching the text's end."""
    return list(range(0, max(1, count - STEP), STEP)) if count else []


def _passages(texts: pa.Array, idf: np.ndarray):
    """(text, its words' hashes, first word, cells, weights) of each passage: a TF-IDF row over the hashed features."""
    for first, _, hashes, counts, _, _ in word_blocks(texts):
        begin = 0
        for k, count in enumerate(counts.tolist(), first):
            words = hashes[begin : begin + count]
            for s in passage_starts(count):
                at, n = np.unique((words[s : s + 2 * STEP] >> SHIFT).astype(np.int32), return_counts=True)
                yield k, words, s, at, (n * idf[at]).astype(np.float32)
            begin += count


def _unit_rows(passages, length: float = 1.0) -> pa.RecordBatch:
    """(at array<int>, v array<float>): the passages' rows, each of ``length``."""
    rows = [(at, v * np.float32(length / np.linalg.norm(v))) for _, _, _, at, v in passages]
    return pa.RecordBatch.from_arrays([pa.array([at for at, _ in rows], pa.list_(pa.int32())), pa.array([v for _, v in rows], pa.list_(pa.float32()))], names=["at", "v"])


def _add_passages(hashes: np.ndarray, counts: np.ndarray, weights: np.ndarray, total: np.ndarray, rng: np.random.Generator) -> int:
    """Adds each passage's TF-IDF row of length 1, with a random sign, to a random row of ``total`` (flat, one cell more at
    the end); their number. weights: by feature, and 0 for what stands behind a text's end."""
    begins = np.cumsum(counts) - counts
    many = np.maximum(-(-counts // STEP) - 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(counts)), many)
    at = begins[owner] + STEP * (np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many))
    ends = (begins + counts)[owner]
    cells, place = (hashes >> SHIFT).astype(np.uint16), np.arange(2 * STEP, dtype=np.int16)
    for k in range(0, len(at), 4096):
        spots = at[k : k + 4096, None] + place
        words = np.where(spots < ends[k : k + 4096, None], cells[np.minimum(spots, len(cells) - 1)], np.uint16(1 << BITS))
        words.sort(axis=1)
        first = np.ones(words.shape, bool)
        first[:, 1:] = words[:, 1:] != words[:, :-1]
        before = place - np.maximum.accumulate(np.where(first, place, np.int16(0)), axis=1)  # of the same word
        v = weights[words]
        length = np.sqrt(np.einsum("ij,ij,ij->i", v, v, (1 + 2 * before).astype(np.float32)))  # 1 + 3 + 5 ...: the square of a word's count
        v *= (rng.choice((-1, 1), len(words)) / length).astype(np.float32)[:, None]
        drawn = np.sort(rng.integers(0, SKETCH, len(words)))  # signs are free of it; rows in order stay in the processor's caches
        np.add.at(total, ((drawn << BITS)[:, None] + words).ravel(), v.ravel())
    return len(at)


def sketched(docs: DataFrame, idf: np.ndarray) -> tuple[DataFrame, int]:
    """(SKETCH rows (at, v), number of passages): all passages of the column ``text`` by random signs. Every row counts.

    The rows' Gram matrix is, in expectation, that of the passages' TF-IDF rows of length 1. Each task sends its sums in
    slices of CUT features, which Spark adds slice by slice (no task holds more than tasks x 16 KB).
    """
    weights, parts = np.append(idf, np.float32(0)), (1 << BITS) // CUT
    sent = pa.schema([("row", pa.int32()), ("part", pa.int32()), ("at", pa.list_(pa.int32())), ("v", pa.list_(pa.float32())), ("thin", pa.bool_()), ("n", pa.int64())])

    def run(batches):
        total, n = np.zeros((SKETCH << BITS) + 1, np.float32), 0
        rng = np.random.default_rng([23, TaskContext.get().partitionId()])
        for batch in batches:
            for part in slices(batch, 0):
                for _, _, hashes, counts, _, _ in word_blocks(text_array(part.column(0))):
                    if len(hashes):
                        n += _add_passages(hashes, counts, weights, total, rng)
        key = np.arange(64, dtype=np.int32)
        for k in range(0, SKETCH * parts if n else 0, 64):
            some = total[k * CUT : (k + 64) * CUT].reshape(64, CUT)
            held = some != 0
            size = held.sum(axis=1)
            thin = 2 * size < CUT  # sent with the places of its values; others whole
            lists = [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(m)).astype(np.int32)), pa.array(x)) for m, x in ((size * thin, np.nonzero(held & thin[:, None])[1].astype(np.int32)), (np.where(thin, size, CUT), some[held | ~thin[:, None]]))]
            yield pa.RecordBatch.from_arrays([pa.array((k + key) // parts), pa.array((k + key) % parts), *lists, pa.array(thin), pa.array(np.where(k + key, 0, n))], schema=sent)
        del total
        release()

    def add(key, table):
        total = np.zeros(CUT)
        for at, v, thin in zip(table.column("at"), table.column("v"), table.column("thin").to_pylist(), strict=True):
            total[at.values.to_numpy() if thin else slice(None)] += v.values.to_numpy()
        return pa.table({"row": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "v": pa.array([total.astype(np.float32)], pa.list_(pa.float32())), "n": pa.array([sum(table.column("n").to_pylist())], pa.int64())})

    def join(key, table):
        row = np.zeros((parts, CUT), np.float32)
        for k, v in zip(table.column("part").to_pylist(), table.column("v"), strict=True):
            row[k] = v.values.to_numpy()
        at = np.flatnonzero(row).astype(np.int32)
        return pa.table({"at": pa.array([at], pa.list_(pa.int32())), "v": pa.array([row.ravel()[at]], pa.list_(pa.float32())), "n": pa.array([sum(table.column("n").to_pylist())], pa.int64())})

    sums = docs.select("text").mapInArrow(run, "row int, part int, at array<int>, v array<float>, thin boolean, n long").groupBy("row", "part").applyInArrow(add, "row int, part int, v array<float>, n long")
    rows = staged(sums.groupBy("row").applyInArrow(join, "at array<int>, v array<float>, n long"), "passages")
    return rows.select("at", "v"), rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def randomized_svd(rows: DataFrame, features: int, rank: int, extra: int = EXTRA, passes: int = 2, seed: int = 23) -> tuple[np.ndarray, np.ndarray]:
    """(right singular vectors, features x rank; singular values) of the sparse matrix ``rows`` (at, v).

    Each pass multiplies the features-by-(rank + extra) basis with A'A: every task adds up its rows' outer products and
    sends its sums in slices of 512 features, which Spark adds slice by slice. Only the basis reaches the driver.
    """
    width, cut = rank + extra, 512
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(features, width)))[0].astype(np.float32)
    values = np.ones(width)
    for _ in range(passes):

        def multiply(batches, basis=basis):
            total = np.zeros((features, width), np.float32)
            for whole in batches:
                for first in range(0, whole.num_rows, 64):
                    batch, thick = whole.slice(first, 64), []
                    for at, v in zip(batch.column(0), batch.column(1), strict=True):
                        at, v = at.values.to_numpy(), v.values.to_numpy()
                        if 4 * len(at) < features:
                            total[at] += np.outer(v, v @ basis[at])
                        else:  # together with others
                            thick.append(np.zeros(features, np.float32))
                            thick[-1][at] = v
                    if thick:
                        thick = np.array(thick)
                        total += thick.T @ (thick @ basis)
            for k in range(0, features, cut):
                yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "x": pa.array([total[k : k + cut].ravel()], pa.list_(pa.float32()))})
            del total
            release()

        def add(key, table):
            total = sum(x.values.to_numpy().astype(np.float64) for x in table.column("x"))
            return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "x": pa.array([total.astype(np.float32)], pa.list_(pa.float32()))})

        sums = rows.mapInArrow(multiply, "slice int, x array<float>").groupBy("slice").applyInArrow(add, "slice int, x array<float>").toArrow()
        product = np.zeros((features, width))
        for k, x in zip(sums.column("slice").to_pylist(), sums.column("x"), strict=True):
            product[k : k + cut] = x.values.to_numpy().reshape(-1, width)
        basis, upper = np.linalg.qr(product)
        left, values, _ = np.linalg.svd(upper)
        basis = (basis @ left).astype(np.float32)
    return basis[:, :rank], np.sqrt(values[:rank])


def lcs_length(item: list, window: list) -> int:
    """Length of the longest common subsequence, bit-parallel over the item's words."""
    places: dict = {}
    for k, w in enumerate(item):
        places[w] = places.get(w, 0) | (1 << k)
    full = (1 << len(item)) - 1
    row = full
    for w in window:
        if m := places.get(w):
            both = row & m
            row = ((row + both) | (row - both)) & full
    return len(item) - row.bit_count()


class Items:
    """The benchmark's passages: each with its item's id, words and answer (the rarest third of the item's words)."""

    def __init__(self, ids: list, texts: list[str], idf: np.ndarray):
        self.ids, self.words, self.answers, self.passages, cells = [], [], [], [], []
        for k, words, s, at, v in _passages(text_array(pa.array(texts, pa.string())), idf):
            if not s:
                rarity = idf[(words >> SHIFT).astype(np.int64)]
                rare = words[np.argsort(-rarity, kind="stable")[: max(1, -(-len(words) // 3))]]
                said, answer, rare = words.tolist(), set(rare.tolist()), (rare >> SHIFT).astype(np.int64)
            self.ids.append(ids[k])
            self.words.append(said)
            self.answers.append(answer)
            self.passages.append((k, words, s, at, v))
            cells.append(rare)
        self.square = idf * idf
        self.cells = cells
        self.spaces: list[Space] = []

    def fit(self, corpus: DataFrame, count: int, idf: np.ndarray, rank: int) -> None:
        """A space for each ``PART`` passages, fitted on them and ``corpus`` (at, v), which stands for ``count`` passages."""
        weight = max(count, 1) ** 0.5  # no direction of the corpus outweighs a benchmark passage
        for k in range(0, len(self.ids), PART):
            part = self.passages[k : k + PART]
            mine = corpus.sparkSession.createDataFrame(pa.Table.from_batches([_unit_rows(part, weight)]), corpus.schema)
            basis, _ = randomized_svd(corpus.union(mine).coalesce(3), len(idf), rank)
            self.spaces.append(Space(k, basis, idf, part, np.concatenate(self.cells[k : k + PART])))
        del self.passages, self.cells


class Space:
    """A latent space and the passages first, first + 1, ... of the benchmark in it: each feature's product with their latent
    vectors of length 1, and the passages' own lengths."""

    def __init__(self, first: int, basis: np.ndarray, idf: np.ndarray, passages: list, answers: np.ndarray):
        table = (idf[:, None] * basis).astype(np.float32)
        size = np.linalg.norm(table, axis=1)
        live = size > LIVE * size.max()
        live[answers] = True
        self.first = first
        self.row = np.where(live, np.cumsum(live) - 1, -1).astype(np.int32)  # of a feature in the table
        vectors = np.array([(v[live[at]] / idf[at[live[at]]]) @ table[at[live[at]]] for *_, at, v in passages], np.float32)
        latent = np.linalg.norm(vectors, axis=1)
        self.lengths = np.array([np.linalg.norm(v) for *_, v in passages], np.float32)
        self.held = latent / self.lengths  # 1: the passage lies in the space
        self.near = table[live] @ (vectors / np.maximum(latent, 1e-9)[:, None]).T  # a passage's sum of these is its product with each


def find_contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", cosine: float = 0.15, lcs: float = 0.7, answer: float = 0.5, rank: int = RANK, most_items: int = 10_000, most_bytes: int = 16 << 20, keep: list[str] | None = None) -> DataFrame:
    """doc_id, contaminated, items (array<struct<item_id, lcs, answer>> by item), best (largest lcs share, 0 if none).

    One row for each row of ``docs``. An item is in a document if a passage's cosine with one of its passages reaches
    ``cosine``, the longest common subsequence with the words about that passage covers ``lcs`` of the item's words and ``answer`` of
    its answer words occur there. Null or empty texts, and items without a word, match nothing. Repeated rows give
    repeated results, an empty table or benchmark an empty or clean one; items that share an id are one item with
    several texts; an item without an id cannot be named and is left out. The benchmark and its spaces
    (some 25 KB a passage) are sent to every task and searched one by one; more than ``most_items`` items or ``most_bytes`` of their text are an error (call it for parts of the benchmark then). Columns named in ``keep`` pass; others are left out.
    """
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    many, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    if many > most_items or size > most_bytes:
        raise ValueError(f"more than {most_items} benchmark items or {most_bytes} bytes of them")
    listed = items.toArrow().sort_by([("item_id", "ascending"), ("text", "ascending")])
    kept = [c for c in keep or () if c not in ("doc_id", "text", "contaminated", "items", "best")]
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *(F.col(f"`{c}`") for c in kept))
    counts, rows = bucket_df(docs, "text", BITS)
    idf = ((np.log((1.0 + rows) / (1.0 + np.minimum(counts, rows))) + 0.05) ** 2).astype(np.float32)
    known = Items(listed.column("item_id").to_pylist(), listed.column("text").to_pylist(), idf)
    if known.ids:
        known.fit(*sketched(docs, idf), idf, rank)
    found_type = T.ArrayType(T.StructType([T.StructField("item_id", items.schema["item_id"].dataType), T.StructField("lcs", T.DoubleType()), T.StructField("answer", T.DoubleType())]))
    schema = T.StructType([*(f for f in docs.schema if keep or f.name != "text"), T.StructField("contaminated", T.BooleanType()), T.StructField("items", found_type), T.StructField("best", T.DoubleType())])

    def run(batches):
        for whole in batches:
            for batch in slices(whole, 1):
                found = [{} for _ in range(batch.num_rows)]
                if known.ids:
                    for first, _, hashes, counts, _, _ in word_blocks(text_array(batch.column(1))):
                        for k, i, a, b in _candidates(known, hashes, counts, cosine):
                            window = hashes[a:b].tolist()
                            seen = len(known.answers[i].intersection(window)) / len(known.answers[i])
                            if seen >= answer:
                                share = lcs_length(known.words[i], window) / len(known.words[i])
                                if share >= lcs:
                                    item = known.ids[i]
                                    found[first + k][item] = max(found[first + k].get(item, (0.0, 0.0)), (share, seen))
                rows = [[{"item_id": i, "lcs": x[i][0], "answer": x[i][1]} for i in sorted(x)] for x in found]
                yield pa.RecordBatch.from_arrays(
                    [*(c for c, n in zip(batch.columns, batch.schema.names, strict=True) if keep or n != "text"), pa.array([bool(x) for x in rows], pa.bool_()), pa.array(rows, pa.list_(pa.struct([("item_id", listed.schema.field("item_id").type), ("lcs", pa.float64()), ("answer", pa.float64())]))), pa.array([max((y["lcs"] for y in x), default=0.0) for x in rows], pa.float64())],
                    names=schema.names,
                )
        release()

    return docs.mapInArrow(run, schema)


def _candidates(known: Items, hashes: np.ndarray, counts: np.ndarray, cosine: float):
    """(text, item passage, first word, last word + 1 of the passage with its surroundings) of passages near an item passage."""
    if not len(hashes):
        return
    begins = np.cumsum(counts) - counts
    blocks = np.maximum(-(-counts // STEP), np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(counts)), blocks)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    at = begins[owner] + within * STEP
    cells = (hashes >> SHIFT).astype(np.int64)
    last = within == blocks[owner] - 1
    more = np.flatnonzero(~last)  # a passage is a block of STEP words and the next one
    rows = np.flatnonzero(~last | (blocks[owner] == 1))

    def passages(sums):
        out = sums.copy()
        out[more] += sums[more + 1]
        return out[rows]

    norms = np.sqrt(passages(np.add.reduceat(known.square[cells], at)))
    for space in known.spaces:
        sums = np.zeros((len(at), space.near.shape[1]), np.float32)
        spots = space.row[cells]
        places = np.flatnonzero(spots >= 0)  # other words add nothing
        home = np.searchsorted(at, places, "right") - 1
        heads = np.flatnonzero(np.concatenate(([True], home[1:] != home[:-1]))) if len(home) else home
        for k in range(0, len(heads), 512):
            own = heads[k : k + 513]
            part = spots[places[own[0] : own[512] if len(own) > 512 else None]]
            own = own[:512]
            sums[home[own]] = np.add.reduceat(space.near[part], own - own[0], axis=0)
        v = passages(sums)
        for k in range(0, len(rows), 4096):
            least = cosine * np.minimum(norms[k : k + 4096, None], LONGEST * space.lengths)
            for r, i in zip(*np.nonzero(v[k : k + 4096] >= least), strict=True):
                row, item = rows[k + r], space.first + int(i)
                d, reach = owner[row], len(known.words[item])
                yield int(d), item, int(max(begins[d], at[row] - reach)), int(min(begins[d] + counts[d], at[row] + 2 * STEP + reach))
