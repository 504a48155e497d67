"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, and how common each pair is.

A byte-level BPE vocabulary (A) and a piece vocabulary with byte fallback (B) encode a blank and the text. The places where
tokens of both end cut the text into groups; within a group every A token is linked with every B token. The first pass
counts for each id pair the documents that hold it linked. The distinct pairs get a minimal perfect hash, shard by
shard; the tasks' counts become dense vectors indexed by it and are summed in a tree. The second pass aligns the
documents again and looks the counts up; the key that stands at each index is compared.

Both vocabularies always break before a blank that follows no white space, so texts are cut there and each distinct
segment is aligned once for many occurrences.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections import OrderedDict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.bpe import SegmentTreeBpe, byte_letters
from marlstone.llm.common import freed, mix, release, shared_dir, slices
from marlstone.llm.parts import Parts

#: Shards of the pairs, by hash. No vocabularies have more pairs than ids x ids: 6.3 million a shard at 50,257 x 32,000.
SHARDS = 256
#: Segments that a worker knows before it starts anew; links that are looked at together; pairs that a task holds.
SEGMENTS, LINKS, HELD = 1 << 19, 1 << 21, 1 << 22
#: Bytes of shards that a worker keeps.
CACHE = 96 << 20
#: Vectors that one task of the first step of the sum takes together.
FAN = 32
_KEY = np.uint64((1 << 48) - 1)
_WHITE = np.array([b <= 32 and (b == 32 or 9 <= b <= 13 or 28 <= b <= 31) for b in range(256)])
#: First bytes of characters of three bytes among which there is white space.
_WIDE = np.array([b in (0xE1, 0xE2, 0xE3) for b in range(256)])
COUNTS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


# --- two vocabularies ------------------------------------------------------------------------------------------------


class Vocabularies:
    """Ids and bytes of tokens of both; special tokens are never made."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        with open(path_a, encoding="utf-8") as file:
            spec = json.load(file)
        back = {c: b for b, c in enumerate(byte_letters())}
        vocab: dict[str, int] = spec["model"]["vocab"]
        special = {t["content"] for t in spec["added_tokens"] if t.get("special")}
        self.bytes_a = [b""] * (1 + max(vocab.values()))
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(back[c] for c in token)
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path_b)
        n = self.sp.get_piece_size()
        self.bytes_b = [bytes([int(self.sp.id_to_piece(i)[3:5], 16)]) if self.sp.is_byte(i) else self.sp.id_to_piece(i).replace("▁", " ").encode() for i in range(n)]
        self.size_b = n
        self.blank = self.sp.encode("a ")[len(self.sp.encode("a")) :]  # a blank at a text's end; alone it would be no text
        self.len_a, self.len_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))
        self._encode = self._by_rank(spec, vocab, special) or self._by_library(path_a)

    @staticmethod
    def _by_rank(spec: dict, vocab: dict[str, int], special: set[str]):
        """A coder that merges by the rank of what is made, where the file's merges stand in the order of their ids."""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        made = [vocab.get(a + b, -1) for a, b in pairs]
        if made != list(range(256, 256 + len(made))):
            return None
        import tiktoken

        back = {c: b for b, c in enumerate(byte_letters())}
        ranks = {bytes(back[c] for c in t): i for t, i in vocab.items() if t not in special}
        return tiktoken.Encoding("a", pat_str=SegmentTreeBpe.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @staticmethod
    def _by_library(path: str):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        tok.encode_special_tokens = True
        return lambda text: tok.encode(text, add_special_tokens=False).ids

    def encode_a(self, segments: list[str]) -> list[int]:
        """Ids of segments one behind the other. Each begins with a blank; all but the last end in no white space."""
        return self._encode("".join(segments))

    def encode_b(self, segments: list[str]) -> list[list[int]]:
        return [ids or self.blank for ids in self.sp.encode([s[1:] for s in segments], num_threads=1)]


class Segments(Parts):
    """Texts as runs of segments, each with the number of its record. Records stay until ``renew``."""

    def __init__(self, learn):
        super().__init__(learn, None, [], 21)
        self.watch[:] = False  # no text is odd: places that may be odd are not cut

    @staticmethod
    def _cuts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        edge = np.zeros(len(data) + 1, bool)
        edge[bounds] = True
        at = np.flatnonzero(data[1:] == 32) + 1
        before = data[at - 1]
        odd = (before >= 128) & ((data[np.maximum(at - 2, 0)] == 0xC2) | _WIDE[data[np.maximum(at - 3, 0)]])
        edge[at[~_WHITE[before] & ~odd]] = True
        return np.flatnonzero(edge)


class Aligner:
    """Records of segments: whether both vocabularies give the segment's bytes, and counts.

    Without ``shards`` also the keys (A id x size of B + B id) of all links, for counting. With them, and the highest count
    of each A id (``best``), the scores of the links, how many of them are of unknown pairs, and the groups as text.
    """

    def __init__(self, vocabularies: Vocabularies, shards: Shards | None = None, best: np.ndarray | None = None):
        self.v, self.shards, self.best = vocabularies, shards, best
        self.segments = Segments(self._learn)
        if shards is not None:
            as_text = lambda n, end: np.array([b"%d%s" % (i, end) for i in range(n)], object)
            na, nb = len(self.v.bytes_a), self.v.size_b
            self.text_a, self.text_b = {e: as_text(na, e) for e in (b",", b"|")}, {e: as_text(nb, e) for e in (b",", b";", b"")}
        self.renew()

    def renew(self) -> None:
        self.segments.clear()
        self.rows, self.count = np.zeros((1 << 12, 2 + len(COUNTS)), np.int64), 0  # fine, number of keys or of links of unknown pairs, then COUNTS
        self.at = np.zeros(1 << 12, np.int64)
        self.pool, self.used, self.texts = np.zeros(1 << 14, np.uint64), 0, []

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(records of all segments of all texts, number of segments of each). A null or empty text has none."""
        if self.count > SEGMENTS:
            self.renew()
        texts = texts.cast(pa.large_string())
        some = pc.fill_null(pc.greater(pc.binary_length(texts), 0), False)
        blank = pa.scalar("", pa.large_string())
        texts = pc.if_else(some, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), pc.fill_null(texts, ""), blank), blank)
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        return self.segments.encode(data[offsets[0] : offsets[-1]], offsets - offsets[0])

    # --- new segments

    def _learn(self, segments: list[str]) -> list[np.ndarray]:
        first = self.count
        self.count += len(segments)
        while self.count > len(self.rows):
            self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
            self.at = np.concatenate((self.at, np.zeros_like(self.at)))
        self.rows[first : self.count] = 0
        if self.shards is not None:
            self.texts.extend([b""] * len(segments))
        inner = [k for k, s in enumerate(segments) if not s[-1].isspace()]
        if inner:
            self._align([segments[k] for k in inner], first + np.array(inner))
        for k, s in enumerate(segments):
            if s[-1].isspace():
                self._align([s], np.array([first + k]))
        return list(np.arange(first, self.count, dtype=np.uint32)[:, None])

    def _align(self, segments: list[str], where: np.ndarray) -> None:
        v = self.v
        raws = [s.encode() for s in segments]
        sizes = np.fromiter(map(len, raws), np.int64, len(raws))
        ends = np.cumsum(sizes)
        a = np.array(v.encode_a(segments), np.int64)
        lists = v.encode_b(segments)
        b = np.fromiter(itertools.chain.from_iterable(lists), np.int64, sum(map(len, lists)))
        n_b = np.fromiter(map(len, lists), np.int64, len(lists))
        owner_b = np.repeat(np.arange(len(raws)), n_b)
        told = np.bincount(owner_b, v.len_b[b], len(raws)).astype(np.int64)
        whole = b"".join(raws)
        ends_a = np.cumsum(v.len_a[a])
        fine = told == sizes
        if not fine.all() or b"".join([v.bytes_b[i] for i in b.tolist()]) != whole:
            for k in np.flatnonzero(fine).tolist():
                fine[k] = b"".join([v.bytes_b[i] for i in lists[k]]) == raws[k]
        if b"".join([v.bytes_a[i] for i in a.tolist()]) != whole:
            if len(raws) > 1:  # no cut is where A breaks: each by itself
                for k, s in enumerate(segments):
                    self._align([s], where[k : k + 1])
                return
            fine[:] = False
        if not fine.all():
            good = np.flatnonzero(fine)
            if len(good):
                self._align([segments[k] for k in good.tolist()], where[good])
            return
        ends_b = np.cumsum(v.len_b[b])
        cut_a = ends_b[np.minimum(np.searchsorted(ends_b, ends_a), len(ends_b) - 1)] == ends_a
        cut_b = ends_a[np.minimum(np.searchsorted(ends_a, ends_b), len(ends_a) - 1)] == ends_b
        g_a, g_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
        groups = int(cut_a.sum())
        in_a, in_b = np.bincount(g_a, minlength=groups), np.bincount(g_b, minlength=groups)
        seg_of = np.searchsorted(ends, ends_a[cut_a])
        rows = np.zeros((len(raws), self.rows.shape[1]), np.int64)
        rows[:, 0] = 1
        for column, weight in ((2, in_a), (3, in_b), (4, np.ones(groups, np.int64)), (5, in_a * in_b)):
            np.add.at(rows[:, column], seg_of, weight)
        if self.shards is None:
            keys, owners = zip(*self._links(a, b, in_a, in_b, seg_of, distinct=True), strict=True)
            self._keep_keys(np.concatenate([k for k, _ in keys]), np.concatenate(owners), rows, where)
        else:
            for (keys, weights), owner in self._links(a, b, in_a, in_b, seg_of, distinct=False):
                counts = self.shards.counts(keys)
                top = counts == self.best[(keys // np.uint64(v.size_b)).astype(np.int64)]
                np.add.at(rows[:, 1], owner, (counts == 0) * weights)
                np.add.at(rows[:, 6], owner, top * weights)
                np.add.at(rows[:, 7], owner, counts * weights)
            self._keep_texts(a, b, cut_a, cut_b, in_a, in_b, g_a, g_b, seg_of, where)
        self.rows[where] = rows

    def _links(self, a, b, in_a, in_b, seg_of, distinct: bool):
        """((keys, weights), owners) of links by runs of groups, about LINKS at a time; a larger group by its distinct ids."""
        links = in_a * in_b
        from_a, from_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        total, first = np.cumsum(links), 0
        while first < len(links):
            base = total[first] - links[first]
            last = max(first + 1, int(np.searchsorted(total, base + LINKS, "right")))
            if links[first] > LINKS:
                ids_a, n_a = np.unique(a[from_a[first] : from_a[first] + in_a[first]], return_counts=True)
                ids_b, n_b = np.unique(b[from_b[first] : from_b[first] + in_b[first]], return_counts=True)
                step = max(1, LINKS // len(ids_b))
                for k in range(0, len(ids_a), step):
                    keys = (ids_a[k : k + step, None] * self.v.size_b + ids_b).ravel().astype(np.uint64)
                    yield (keys, np.outer(n_a[k : k + step], n_b).ravel()), np.full(len(keys), seg_of[first])
                last = first + 1
            else:
                g = np.arange(first, last)
                tokens = np.arange(from_a[first], from_a[last - 1] + in_a[last - 1])
                repeats = np.repeat(in_b[g], in_a[g])
                starts = np.repeat(from_b[g], in_a[g])
                left = np.repeat(a[tokens], repeats)
                right = np.repeat(starts - (np.cumsum(repeats) - repeats), repeats) + np.arange(int(repeats.sum()))
                yield ((left * self.v.size_b + b[right]).astype(np.uint64), 1), np.repeat(np.repeat(seg_of[g], in_a[g]), repeats)
            first = last

    def _keep_keys(self, keys, owners, rows, where) -> None:
        while self.used + len(keys) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        self.pool[self.used : self.used + len(keys)] = keys
        rows[:, 1] = np.bincount(owners, minlength=len(rows))
        self.at[where] = self.used + np.cumsum(rows[:, 1]) - rows[:, 1]
        self.used += len(keys)

    def _keep_texts(self, a, b, cut_a, cut_b, in_a, in_b, g_a, g_b, seg_of, where) -> None:
        out = np.empty(len(a) + len(b), object)
        last_of = np.ones(len(seg_of), bool)
        last_of[:-1] = seg_of[1:] != seg_of[:-1]
        at_a = np.arange(len(a)) + (np.cumsum(in_b) - in_b)[g_a]
        at_b = np.arange(len(b)) + np.cumsum(in_a)[g_b]
        out[at_a] = self.text_a[b","][a]
        out[at_a[cut_a]] = self.text_a[b"|"][a[cut_a]]
        out[at_b] = self.text_b[b","][b]
        final = last_of[g_b[cut_b]]
        out[at_b[cut_b]] = np.where(final, self.text_b[b""][b[cut_b]], self.text_b[b";"][b[cut_b]])
        pieces, ends = out.tolist(), np.bincount(seg_of, in_a + in_b, len(where)).astype(np.int64).cumsum().tolist()
        for k, s, e in zip(where.tolist(), [0, *ends[:-1]], ends, strict=True):
            self.texts[k] = b"".join(pieces[s:e])


@lru_cache(1)
def vocabularies(path_a: str, path_b: str) -> Vocabularies:
    return Vocabularies(path_a, path_b)


@lru_cache(1)
def _counting(path_a: str, path_b: str) -> Aligner:
    return Aligner(vocabularies(path_a, path_b))


@lru_cache(1)
def _scoring(path_a: str, path_b: str, tables: tuple[str, str], best: bytes) -> Aligner:
    _counting.cache_clear()
    return Aligner(vocabularies(path_a, path_b), Shards(*tables), np.frombuffer(best, np.int64))


# --- minimal perfect hashing -----------------------------------------------------------------------------------------


class PerfectHash:
    """Indices 0 to n - 1 of n distinct 64-bit keys: levels of bits, of which each says that one key alone falls there.

    Keys that meet others on a level go to the next one; the index is the number of set bits before the key's.
    """

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.bases = np.cumsum(sizes) - sizes
        self.ranks = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))[:-1] if len(words) else np.zeros(0, np.int64)

    @staticmethod
    def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, levels, left = [], [], keys
        while len(left):
            size = -(-2 * len(left) // 64) * 64
            at = cls._places(left, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[at]]
        return cls(np.array(sizes, np.int64), np.concatenate(levels) if levels else np.zeros(0, np.uint64))

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key; -1 for what falls on no set bit (other strange keys get the index of some key)."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (size, base) in enumerate(zip(self.sizes.tolist(), self.bases.tolist(), strict=True)):
            if not len(left):
                break
            bit = base + self._places(keys[left], level, size)
            word, within = bit >> 6, (bit & 63).astype(np.uint64)
            there = (self.words[word] >> within) & np.uint64(1) == 1
            hit = left[there]
            below = self.words[word[there]] & ((np.uint64(1) << within[there]) - np.uint64(1))
            out[hit] = self.ranks[word[there]] + np.bitwise_count(below)
            left = left[~there]
        return out


def shard_of(keys: np.ndarray) -> np.ndarray:
    return (mix(keys) >> np.uint64(56)).astype(np.int64) % SHARDS


class Shards:
    """Shards of pairs (hash and keys) and of counts, read from the shared folder when asked for; at most CACHE bytes stay."""

    def __init__(self, pairs: str, counts: str | None = None):
        self.paths, self.kept, self.bytes = [pairs, counts], OrderedDict(), 0

    @staticmethod
    def _row(path: str, shard: int) -> dict | None:
        fs, root = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))
        files = fs.get_file_info(pafs.FileSelector(f"{root}/shard={shard}", allow_not_found=True))
        for f in files:
            if f.size and f.base_name.endswith(".parquet"):
                with fs.open_input_file(f.path) as file:
                    rows = pq.ParquetFile(file).read().to_pylist()
                if rows:
                    return rows[0]
        return None

    def get(self, shard: int) -> tuple[PerfectHash, np.ndarray, np.ndarray | None]:
        """The hash, the keys by index and the counts by index; a shard without pairs is empty."""
        if shard in self.kept:
            self.kept.move_to_end(shard)
            return self.kept[shard][0]
        row = self._row(self.paths[0], shard)
        if row is None:
            return PerfectHash.build(np.zeros(0, np.uint64)), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        keys = np.frombuffer(row["keys"], np.uint64)
        hashed = PerfectHash(np.array(row["sizes"], np.int64), np.frombuffer(row["words"], np.uint64))
        counts = np.frombuffer(self._row(self.paths[1], shard)["sums"], np.int64) if self.paths[1] else None
        size = keys.nbytes * (2 if counts is None else 3)
        while self.kept and self.bytes + size > CACHE:
            self.bytes -= self.kept.popitem(last=False)[1][1]
        self.kept[shard] = ((hashed, keys, counts), size)
        self.bytes += size
        return self.kept[shard][0]

    def places(self, shard: int, keys: np.ndarray) -> np.ndarray:
        """Index of each key, -1 where another key stands there."""
        hashed, there, _ = self.get(shard)
        at = hashed.index(keys)
        at[at >= 0] = np.where(there[at[at >= 0]] == keys[at >= 0], at[at >= 0], -1)
        return at

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Count of each key, 0 for unknown ones."""
        known, back = np.unique(keys, return_inverse=True)
        shards = shard_of(known)
        order = np.argsort(shards, kind="stable")
        bounds = np.searchsorted(shards[order], np.arange(SHARDS + 1))
        out = np.zeros(len(known), np.int64)
        for s in np.unique(shards).tolist():
            some = order[bounds[s] : bounds[s + 1]]
            at = self.places(s, known[some])
            out[some[at >= 0]] = self.get(s)[2][at[at >= 0]]
        return out[back]


# --- Spark -----------------------------------------------------------------------------------------------------------


def _sum_by_key(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    flat, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(flat, kind="stable")
    flat, n = flat[order], n[order]
    starts = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1]))) if len(flat) else np.zeros(0, np.int64)
    return flat[starts], np.add.reduceat(n, starts) if len(starts) else n


def _gather(at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.repeat(at - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def _documents_of_pairs(df: DataFrame, text: str, path_a: str, path_b: str) -> DataFrame:
    """shard, keys and counts: for each task its distinct pairs and how many of its documents hold them."""
    names, kinds = ["shard", "keys", "counts"], [pa.int32(), pa.binary(), pa.binary()]

    def rows(keys, counts):
        shards = shard_of(keys)
        order = np.argsort(shards, kind="stable")
        bounds = np.searchsorted(shards[order], np.arange(SHARDS + 1))
        for s in range(SHARDS):
            some = order[bounds[s] : bounds[s + 1]]
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((s, keys[some].tobytes(), counts[some].tobytes()), kinds, strict=True)], names=names)

    def run(batches):
        aligner = _counting(path_a, path_b)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            for part in slices(batch, 0):
                records, counts = aligner.encode(part.column(0))
                owner = np.repeat(np.arange(len(counts)), counts)
                broken = np.bincount(owner, aligner.rows[records, 0] == 0, len(counts)) > 0
                once = np.unique((owner << 32) | records)
                owner, records = once >> 32, once & 0xFFFFFFFF
                owner, records = owner[~broken[owner]], records[~broken[owner]]
                sizes = aligner.rows[records, 1]
                keys = aligner.pool[_gather(aligner.at[records], sizes)]
                once = np.unique((np.repeat(owner, sizes).astype(np.uint64) << np.uint64(48)) | keys)
                held.append(np.unique(once & _KEY, return_counts=True))
                size += len(held[-1][0])
                if size > HELD:
                    held = [_sum_by_key(*zip(*held, strict=True))]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield from rows(*held[0])
                        held, size = [], 0
        if held:
            yield from rows(*_sum_by_key(*zip(*held, strict=True)))
        release()

    return df.select(text).mapInArrow(run, "shard int, keys binary, counts binary")


def _hashes(found: DataFrame) -> DataFrame:
    """One row for each shard: a perfect hash of its distinct keys, and the keys in the order of their indices."""

    def row(shard, keys):
        made = PerfectHash.build(keys)
        placed = np.empty_like(keys)
        placed[made.index(keys)] = keys
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([made.sizes.tolist()], pa.list_(pa.int64())), pa.array([made.words.tobytes()], pa.binary()), pa.array([placed.tobytes()], pa.binary())], names=["shard", "sizes", "words", "keys"])

    def run(batches):
        held, parts, size = None, [], 0
        for batch in batches:
            for shard, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if shard != held:
                    if parts:
                        yield row(held, np.unique(np.concatenate(parts)))
                    held, parts, size = shard, [], 0
                parts.append(np.frombuffer(raw.as_py(), np.uint64))
                size += len(parts[-1])
                if size > HELD:
                    parts = [np.unique(np.concatenate(parts))]
                    size = len(parts[0])
        if parts:
            yield row(held, np.unique(np.concatenate(parts)))
        release()

    return found.select("shard", "keys").repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "shard int, sizes array<long>, words binary, keys binary")


def _dense(found: DataFrame, pairs: str) -> DataFrame:
    """The tasks' counts as dense vectors by the pairs' hash, those of one task summed."""

    def run(batches):
        shards, sums, size = Shards(pairs), {}, 0
        branch = TaskContext.get().partitionId() // FAN

        def flush():
            for s, vector in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([branch], pa.int32()), pa.array([vector.tobytes()], pa.binary())], names=["shard", "branch", "sums"])
            sums.clear()

        for batch in batches:
            for shard, keys, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if shard not in sums:
                    n = len(shards.get(shard)[1])
                    if sums and size + n > HELD:
                        yield from flush()
                        size = 0
                    sums[shard], size = np.zeros(n, np.int64), size + n
                at = shards.places(shard, np.frombuffer(keys.as_py(), np.uint64))
                if (at < 0).any():
                    raise KeyError(f"a counted pair has no place in shard {shard}")
                sums[shard][at] += np.frombuffer(counts.as_py(), np.int64)
        yield from flush()
        release()

    return found.mapInArrow(run, "shard int, branch int, sums binary")


def _summed(vectors: DataFrame, by: list[str]) -> DataFrame:
    """Vectors of one key summed as they come, so that a task holds one vector and what it reads."""
    dealt = vectors.select(*by, "sums").repartition(*by).sortWithinPartitions(*by)

    def run(batches):
        held, total = None, None

        def row():
            return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int32()) for x in held), pa.array([total.tobytes()], pa.binary())], names=[*by, "sums"])

        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(len(by))), strict=True))
            for key, raw in zip(keys, batch.column(len(by)), strict=True):
                vector = np.frombuffer(raw.as_py(), np.int64)
                if key == held:
                    total += vector
                else:
                    if held is not None:
                        yield row()
                    held, total = key, vector.copy()
        if held is not None:
            yield row()

    return dealt.mapInArrow(run, ", ".join(f"{c} int" for c in by) + ", sums binary")


def count_pairs(df: DataFrame, path_a: str, path_b: str, text: str = "text") -> tuple[str, str]:
    """Paths of two tables by shard: the distinct linked pairs with their perfect hash, and their document counts."""
    spark = df.sparkSession
    root = shared_dir(spark)
    found = freed(_documents_of_pairs(df, text, path_a, path_b), "pairs-by-task")
    _hashes(found).write.partitionBy("shard").parquet(f"{root}/pairs")
    vectors = _summed(_dense(found, f"{root}/pairs"), ["shard", "branch"])
    _summed(vectors, ["shard"]).write.partitionBy("shard").parquet(f"{root}/counts")
    return f"{root}/pairs", f"{root}/counts"


def pair_counts(spark: SparkSession, tables: tuple[str, str], path_a: str, path_b: str) -> DataFrame:
    """a_id, b_id and n_docs of every pair, read from the tables of ``count_pairs``."""
    size = vocabularies(path_a, path_b).size_b

    def run(batches):
        shards = Shards(*tables)
        for batch in batches:
            for s in batch.column(0).to_pylist():
                if shards._row(tables[0], s) is None:
                    continue
                _, keys, counts = shards.get(s)
                for k in range(0, len(keys), 1 << 16):
                    ids = keys[k : k + (1 << 16)].astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array((ids // size).astype(np.int32)), pa.array((ids % size).astype(np.int32)), pa.array(counts[k : k + (1 << 16)])], names=["a_id", "b_id", "n_docs"])

    return spark.range(SHARDS).mapInArrow(run, "a_id int, b_id int, n_docs long")


def align_documents(df: DataFrame, path_a: str, path_b: str, text: str = "text", digest: bool = False) -> DataFrame:
    """Adds n_a, n_b, n_groups, n_links, n_best, count_sum and groups (``a1,a2|b1;a3|b2,b3``: ids by group) to each row.

    n_links: A-B token pairs that share a group; count_sum: over them, in how many of ``df``'s rows the id pair is linked;
    n_best: those whose count is the highest of all pairs with their A id (ties included). digest: ``groups`` is its SHA-256
    in hex. Null and empty texts and texts that one vocabulary does not give back byte by byte have zeros and an empty
    ``groups`` and count for no pair. Repeated rows are documents of their own. Columns of the same names are replaced,
    others stay; an empty table gives an empty table. The counts per A id that go to all tasks are bounded by the
    vocabulary.
    """
    spark = df.sparkSession
    tables = count_pairs(df, path_a, path_b, text)
    size_a = len(vocabularies(path_a, path_b).bytes_a)
    top = pair_counts(spark, tables, path_a, path_b).groupBy("a_id").agg(F.max("n_docs").alias("n")).toArrow()
    best = np.zeros(size_a, np.int64)
    best[top.column("a_id").to_numpy()] = top.column("n").to_numpy()
    best = best.tobytes()
    keep = [c for c in df.columns if c not in (*COUNTS, "groups")]
    df = df.select(*(F.col(f"`{c}`") for c in keep))
    schema = T.StructType([*df.schema.fields, *(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("groups", T.StringType())])
    at = keep.index(text)

    def run(batches):
        aligner = _scoring(path_a, path_b, tables, best)
        for batch in batches:
            for part in slices(batch, at):
                records, counts = aligner.encode(part.column(at))
                ends = np.cumsum(counts)
                sums = np.concatenate((np.zeros((1, aligner.rows.shape[1]), np.int64), np.cumsum(aligner.rows[records], axis=0)))
                sums = sums[ends] - sums[ends - counts]
                good = (counts > 0) & (sums[:, 0] == counts)
                if sums[good, 1].any():
                    raise KeyError("a document holds a pair that was not counted: the table changed between the passes")
                texts, told = [], records.tolist()
                for ok, s, e in zip(good.tolist(), (ends - counts).tolist(), ends.tolist(), strict=True):
                    groups = b";".join([aligner.texts[r] for r in told[s:e]]) if ok else b""
                    texts.append("" if not ok else hashlib.sha256(groups).hexdigest() if digest else groups.decode())
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(np.where(good, sums[:, 2 + k], 0)) for k in range(len(COUNTS))), pa.array(texts, pa.string())], names=schema.names)
        release()

    return df.mapInArrow(run, schema)
