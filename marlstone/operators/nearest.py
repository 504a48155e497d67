"""Nearest texts by cosine of sparse vectors: exact by an upper bound on each pair, or from the best by head alone.

Texts travel as their grams (codes and counts, packed) and vectors as term numbers and counts (``terms``, packed) with the
length to divide by. Vectors of unit length are turned into a head (coordinates along an orthonormal basis) and the length
of the rest. The cosine of two is at most the product of their heads plus the product of the rests' lengths, and only pairs
that the bound leaves open are multiplied in full. The basis is fitted on a bounded sample; any basis gives right bounds, a
good one close ones. Queries are written once and every task reads all of them, block by block, against its own part of
the reference, so that no pair of blocks is shuffled.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.shared import shared_path, written

#: What rounding in heads of 32 bits may add to or take from a product of unit vectors.
SLACK = 1e-4
#: Cosines are compared to so many places.
PLACES = 9
#: Coordinates of the heads by which each query finds a first partner.
FIRST = 128
#: Above this share of open partners a query is multiplied with all of them at once.
MANY = 0.01


def _small(x: np.ndarray) -> tuple[bytes, bytes]:
    """(width, bytes) of numbers that are not negative, the bytes of each place together."""
    top = int(x.max()) if len(x) else 0
    width = next(k for k in (1, 2, 4, 8) if top < 1 << 8 * k)
    return bytes([width]), np.ascontiguousarray(x.astype(f"<u{width}")).view(np.uint8).reshape(-1, width).T.tobytes()


def _large(width: int, raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(f"<u{width}").ravel().astype(np.int64)


def packed(ids: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending numbers and their counts, compressed."""
    (a, x), (b, y) = _small(np.diff(ids, prepend=0)), _small(counts)
    return zlib.compress(a + b + x + y, 1)


def unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(raw)
    n = (len(raw) - 2) // (raw[0] + raw[1])
    return np.cumsum(_large(raw[0], raw[2 : 2 + n * raw[0]])), _large(raw[1], raw[2 + n * raw[0] :])


@dataclass(frozen=True)
class Grams:
    """Character n-grams of texts as numbers or bytes that sort as the grams do (by code point)."""

    n: int

    @property
    def kind(self) -> str:
        return "long" if self.n <= 3 else "binary"

    def counted(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct grams in order and how often each stands in the text."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        m = max(0, len(points) - self.n + 1)
        if self.n <= 3:
            codes = np.zeros(m, np.int64)
            for k in range(self.n):
                codes = codes << 21 | points[k : k + m]
        else:  # three bytes a character, none of them 0
            digits = (np.stack([points >> 14, points >> 7 & 127, points & 127], 1) + 1).astype(np.uint8)
            codes = np.concatenate([digits[k : k + m] for k in range(self.n)], 1).ravel().view(f"S{3 * self.n}") if m else np.zeros(0, f"S{3 * self.n}")
        return np.unique(codes, return_counts=True)

    def pack(self, text: str) -> bytes:
        codes, counts = self.counted(text)
        if self.n > 3:
            width, raw = _small(counts)
            return zlib.compress(width + raw + codes.tobytes(), 1)
        letters, at = np.unique([codes >> 21 * k & 0x1FFFFF for k in range(self.n)], return_inverse=True)  # numbered among the text's own letters
        ids = sum(x * len(letters) ** k for k, x in enumerate(at.reshape(self.n, -1).astype(np.int64)))
        return len(letters).to_bytes(4, "little") + letters.astype("<u4").tobytes() + packed(np.asarray(ids, np.int64).reshape(-1), counts)

    def unpack(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        if self.n > 3:
            raw = zlib.decompress(raw)
            m = (len(raw) - 1) // (raw[0] + 3 * self.n)
            return np.frombuffer(raw[1 + m * raw[0] :], f"S{3 * self.n}"), _large(raw[0], raw[1 : 1 + m * raw[0]])
        size = int.from_bytes(raw[:4], "little")
        letters = np.frombuffer(raw[4 : 4 + 4 * size], "<u4").astype(np.int64)
        ids, counts = unpacked(raw[4 + 4 * size :])
        codes = np.zeros(len(ids), np.int64)
        for k in range(self.n if size else 0):
            codes |= letters[ids // size**k % size] << 21 * k
        return codes, counts

    def rows(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """key, digest (SHA-256 of the text) and grams of each row; of null both are null."""

        def run(batches):
            for batch in batches:
                for k in range(0, batch.num_rows, 256):
                    part = batch.slice(k, 256)
                    texts = part.column(1).to_pylist()
                    digests = pa.array([t if t is None else hashlib.sha256(t.encode()).digest() for t in texts], pa.binary())
                    yield pa.RecordBatch.from_arrays([part.column(0), digests, pa.array([t if t is None else self.pack(t) for t in texts], pa.binary())], names=[key, "digest", "grams"])

        return df.select(key, text).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, digest binary, grams binary")

    def vocabulary(self, df: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(grams in order, how many rows have each): the ``most`` most frequent grams, ties by gram."""

        def run(batches):
            for batch in batches:
                for k in range(0, batch.num_rows, 2048):
                    pairs = [self.unpack(raw) for raw in batch.column(0).slice(k, 2048).to_pylist()]
                    terms, at = np.unique(np.concatenate([p[0] for p in pairs]), return_inverse=True)
                    total = np.bincount(at, np.concatenate([p[1] for p in pairs]), len(terms)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(terms.tolist(), pa.int64() if self.n <= 3 else pa.binary()), pa.array(np.bincount(at, minlength=len(terms))), pa.array(total)], names=["term", "df", "total"])

        counts = df.select("grams").mapInArrow(run, f"term {self.kind}, df long, total long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
        rows = sorted((r.term if self.n <= 3 else bytes(r.term), r.df) for r in counts.orderBy(F.desc("total"), "term").limit(most).collect())
        return np.array([t for t, _ in rows], np.int64 if self.n <= 3 else f"S{3 * self.n}"), np.array([n for _, n in rows], np.int64)


@dataclass(frozen=True)
class Weights:
    """Vectors of packed terms: counts times the terms' weights, divided by the vector's length."""

    grams: Grams
    vocab: np.ndarray
    weight: np.ndarray

    def vectors(self, df: DataFrame) -> DataFrame:
        """Instead of grams terms and norm; rows without a known gram are left out."""
        carried = [c for c in df.columns if c != "grams"]

        def one(raw: bytes) -> tuple[bytes, float] | None:
            codes, counts = self.grams.unpack(raw)
            at = np.searchsorted(self.vocab, codes)
            good = at < len(self.vocab)
            good[good] = self.vocab[at[good]] == codes[good]
            return (packed(at[good], counts[good]), float(np.linalg.norm(counts[good] * self.weight[at[good]]))) if good.any() else None

        def run(batches):
            for batch in batches:
                found = [one(raw) for raw in batch.column("grams").to_pylist()]
                rows = np.array([k for k, f in enumerate(found) if f], np.int64)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(rows)) for c in carried), pa.array([found[k][0] for k in rows], pa.binary()), pa.array([found[k][1] for k in rows], pa.float64())], names=[*carried, "terms", "norm"])

        kinds = dict(df.dtypes)
        return df.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in carried) + ", terms binary, norm double")

    def lists(self, terms: list[bytes], norm: np.ndarray) -> tuple[pa.ListArray, pa.ListArray]:
        """The columns at and w of vectors."""
        pairs = [unpacked(raw) for raw in terms]
        at = np.concatenate([p[0] for p in pairs]) if pairs else np.zeros(0, np.int64)
        sizes = np.array([len(p[0]) for p in pairs], np.int64)
        w = (np.concatenate([p[1] for p in pairs]) if pairs else np.zeros(0)) * self.weight[at] / np.repeat(norm, sizes)
        ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        return pa.ListArray.from_arrays(ends, pa.array(at.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(w))

    def sparse(self, df: DataFrame) -> DataFrame:
        """Instead of terms and norm the arrays at and w."""
        carried = [c for c in df.columns if c not in ("terms", "norm")]
        kinds = dict(df.dtypes)

        def run(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), *self.lists(batch.column("terms").to_pylist(), batch.column("norm").to_numpy())], names=[*carried, "at", "w"])

        return df.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in carried) + ", at array<int>, w array<double>")


def _dense(at: pa.ListArray, w: pa.ListArray, width: int, kind=np.float64) -> np.ndarray:
    out = np.zeros((len(at), width), kind)
    out[np.repeat(np.arange(len(at)), np.diff(at.offsets.to_numpy())), at.flatten().to_numpy()] = w.flatten().to_numpy()  # flatten: of a slice its own part
    return out


def _lists(table: pa.Table) -> tuple[pa.ListArray, pa.ListArray]:
    """The columns at and w with offsets from 0."""
    return tuple(pa.concat_arrays([table.column(c).combine_chunks()]) if table.num_rows else pa.array([], pa.list_(k)) for c, k in (("at", pa.int32()), ("w", pa.float64())))


def _directions(rows: np.ndarray, rank: int) -> np.ndarray:
    """Orthonormal columns: the main directions of dense rows."""
    values, left = np.linalg.eigh(rows @ rows.T)
    keep = [k for k in range(len(values) - 1, -1, -1) if values[k] > 1e-6][:rank]
    basis = rows.T @ (left[:, keep] / np.sqrt(values[keep])) if keep else np.zeros((rows.shape[1], 0), np.float32)
    return np.linalg.qr(basis)[0].astype(np.float32, copy=False) if keep else basis


def fit_basis(vectors: DataFrame, key: str, width: int, rank: int = 512, sample: int = 2000) -> np.ndarray:
    """Orthonormal columns (width x rank at most): the main directions of ``sample`` vectors drawn by hash of ``key``."""
    table = vectors.orderBy(F.xxhash64(key, F.lit(29)), key).limit(sample).select("at", "w").toArrow()
    return _directions(_dense(*_lists(table), width, np.float32), rank)


def _own(table: pa.Table) -> np.ndarray:
    """Keys that are no partners; where there is none, one that no partner has."""
    return pc.fill_null(table.column("own").cast(pa.int64()), -(2**63)).to_numpy()[:, None]


def _cosines(asked: np.ndarray, i: np.ndarray, j: np.ndarray, at: pa.ListArray, w: pa.ListArray) -> np.ndarray:
    """Full products of pairs: dense rows i of ``asked`` with sparse rows j, some millions of terms at a time."""
    offsets, ids, weights = at.offsets.to_numpy(), at.values.to_numpy(), w.values.to_numpy()
    sizes = np.diff(offsets)[j]
    out, ends, first = np.zeros(len(i)), np.cumsum(sizes), 0
    while first < len(i):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first] - sizes[first]) + 4_000_000, "right")))
        n = sizes[first:last]
        spots = np.repeat(offsets[j[first:last]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        owner = np.repeat(np.arange(last - first), n)
        out[first:last] = np.bincount(owner, asked[i[first:last][owner], ids[spots]] * weights[spots], last - first)
        first = last
    return np.round(out, PLACES)


def dealt(df: DataFrame, rows: int, name: str = "table") -> DataFrame:
    """``written`` in files of so many rows at most, so that few large partitions are read by more tasks."""
    path = f"{shared_path(df.sparkSession)}/{name}"
    df.write.option("maxRecordsPerFile", rows).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


@lru_cache(maxsize=1)
def _loaded(path: str) -> np.ndarray:
    fs, at = _fs(path)
    with fs.open_input_file(at) as file:
        return np.lib.format.read_array(file)


@dataclass(frozen=True)
class Basis:
    """A basis in a shared file, which each worker reads once."""

    path: str
    shape: tuple[int, int]

    @staticmethod
    def fitted(vectors: DataFrame, weights: Weights, rank: int, sample: int = 2000) -> Basis:
        """From ``sample`` vectors (ref_key, terms, norm) drawn by hash: one task fits and saves it, the driver holds none of it."""
        width, path = len(weights.vocab), f"{shared_path(vectors.sparkSession)}/basis"

        def run(batches):
            rows = [r for b in batches for r in zip(b.column("terms").to_pylist(), b.column("norm").to_pylist(), strict=True)]
            basis = _directions(_dense(*weights.lists([t for t, _ in rows], np.array([x for _, x in rows])), width, np.float32), rank)
            fs, at = _fs(path)
            fs.create_dir(at)
            with fs.open_output_stream(f"{at}/basis.npy") as file:
                np.lib.format.write_array(file, np.ascontiguousarray(basis))
            yield pa.RecordBatch.from_arrays([pa.array([basis.shape[1]])], names=["rank"])

        some = vectors.select("ref_key", "terms", "norm").orderBy(F.xxhash64("ref_key", F.lit(29)), "ref_key").limit(sample).coalesce(1)
        found = some.mapInArrow(run, "rank long").collect()
        return Basis(f"{path}/basis.npy", (width, found[0].rank))

    def columns(self, rank: int) -> np.ndarray:
        return np.ascontiguousarray(_loaded(self.path)[:, :rank])


def _read(files: list[str], rows: int) -> Iterator[pa.Table]:
    for f in files:
        fs, path = _fs(f)
        with fs.open_input_file(path) as file:
            yield from (pa.Table.from_batches([b]) for b in pq.ParquetFile(file).iter_batches(rows))


def _slabs(batches, size: int) -> Iterator[pa.Table]:
    """Tables of ``size`` rows at most, of neighbouring batches."""
    kept, n = [], 0
    for batch in batches:
        for k in range(0, batch.num_rows, size):
            piece = batch.slice(k, size)
            if n + piece.num_rows > size:
                yield pa.Table.from_batches(kept)
                kept, n = [], 0
            kept.append(piece)
            n += piece.num_rows
    if n:
        yield pa.Table.from_batches(kept)


def _projected(weights: Weights, terms: list[bytes], norm: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, pa.ListArray, pa.ListArray]:
    """Heads and the columns at and w of vectors, 512 at a time."""
    heads, ats, ws = np.zeros((len(terms), basis.shape[1]), np.float32), [], []
    for k in range(0, len(terms), 512):
        at, w = weights.lists(terms[k : k + 512], norm[k : k + 512])
        heads[k : k + 512] = _dense(at, w, basis.shape[0], np.float32) @ basis
        ats.append(at)
        ws.append(w)
    return heads, pa.concat_arrays(ats), pa.concat_arrays(ws)


def _rests(heads: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 1 - np.einsum("ij,ij->i", heads, heads)) + SLACK).astype(np.float32)


def with_short_heads(vectors: DataFrame, weights: Weights, basis: Basis) -> DataFrame:
    """Adds head (binary, 16-bit floats), rest, and extra (what the 16 bits may take from a product with a unit vector)."""
    names, kinds = vectors.columns, dict(vectors.dtypes)

    def run(batches):
        columns = basis.columns(basis.shape[1])
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                heads, _, _ = _projected(weights, part.column("terms").to_pylist(), part.column("norm").to_numpy(), columns)
                short = heads.astype(np.float16)
                extra = np.linalg.norm(heads - short, axis=1).astype(np.float32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([h.tobytes() for h in short], pa.binary()), pa.array(_rests(heads)), pa.array(extra)], names=[*names, "head", "rest", "extra"])

    return vectors.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names) + ", head binary, rest float, extra float")


@dataclass(frozen=True)
class Search:
    """Best partners among reference vectors (ref_key, terms, norm) of queries written with short heads.

    Each task holds ``part`` vectors of its share of the reference at a time and reads the queries ``block`` by ``block``; it
    keeps the best partner of each query so far (a few numbers a query).
    """

    weights: Weights
    basis: Basis
    block: int
    part: int

    def _asked(self, files: list[str]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
        """Queries block by block with their heads and dense vectors."""
        width, rank = self.basis.shape
        for left in _read(files, self.block):
            heads = np.frombuffer(b"".join(left.column("head").to_pylist()), np.float16).reshape(left.num_rows, rank).astype(np.float32)
            yield left, heads, _dense(*self.weights.lists(left.column("terms").to_pylist(), left.column("norm").to_numpy()), width)

    def _kept(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.full(n, -1.0), np.zeros(n, np.int64), np.zeros(n, np.int64)

    def _run(self, batches, files: list[str], slab: Callable) -> Iterator[pa.RecordBatch]:
        """slab(right) gives a function of a block that betters what is kept of its queries."""
        kept: list[tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]] = []
        for right in _slabs(batches, self.part):
            better = slab(right)
            for k, (left, heads, dense) in enumerate(self._asked(files)):
                if k == len(kept):
                    kept.append((left.column("query_key").to_numpy(), self._kept(left.num_rows)))
                better(left, heads, dense, *kept[k][1])
        for keys, (best, who, count) in kept:
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(best, mask=best < 0), pa.array(who, mask=best < 0), pa.array(count)], names=["query_key", "cosine", "ref_key", "multiplied"])

    def _take(self, dense: np.ndarray, i: np.ndarray, j: np.ndarray, keys: np.ndarray, lists, best: np.ndarray, who: np.ndarray) -> None:
        """Multiplies pairs and keeps the best of each query; equal cosines: the smallest key."""
        for s in range(0, len(i), 1 << 15):
            ii, jj = i[s : s + (1 << 15)], j[s : s + (1 << 15)]
            value = _cosines(dense, ii, jj, *lists)
            order = np.lexsort((-keys[jj], value, ii))
            last = order[np.flatnonzero(np.append(ii[order][1:] != ii[order][:-1], True))]
            rows, top, key = ii[last], value[last], keys[jj[last]]
            better = (top > best[rows]) | ((top == best[rows]) & (key < who[rows]))
            best[rows[better]], who[rows[better]] = top[better], key[better]

    def first(self, ref: DataFrame, files: list[str]) -> DataFrame:
        """query_key and the cosine of some partner, as good a one as the first coordinates of the heads tell."""

        def slab(right: pa.Table):
            keys, (heads, *lists) = right.column("ref_key").to_numpy(), _projected(self.weights, right.column("terms").to_pylist(), right.column("norm").to_numpy(), self.basis.columns(FIRST))

            def better(left, q, dense, best, who, count):
                scores = np.ascontiguousarray(q[:, :FIRST]) @ heads.T
                scores[_own(left) == keys] = -2.0
                j = scores.argmax(axis=1)
                i = np.flatnonzero(scores[np.arange(len(j)), j] > -2.0)
                self._take(dense, i, j[i], keys, lists, best, who)

            return better

        met = ref.select("ref_key", "terms", "norm").mapInArrow(lambda batches: self._run(batches, files, slab), "query_key long, cosine double, ref_key long, multiplied long")
        return met.groupBy("query_key").agg(F.max("cosine").alias("cosine"))

    def likely(self, ref: DataFrame, files: list[str], keep: int) -> DataFrame:
        """query_key, cosine, ref_key and multiplied: the best of the ``keep`` partners by head in each ``part`` of the reference."""

        def slab(right: pa.Table):
            keys, (heads, *lists) = right.column("ref_key").to_numpy(), _projected(self.weights, right.column("terms").to_pylist(), right.column("norm").to_numpy(), self.basis.columns(self.basis.shape[1]))
            rests, n = _rests(heads), min(keep, len(keys))

            def better(left, q, dense, best, who, count):
                scores = q @ heads.T
                scores[_own(left) == keys] = -2.0
                top = np.argpartition(scores, len(keys) - n, axis=1)[:, len(keys) - n :]
                value = np.take_along_axis(scores, top, 1)
                bound = value + left.column("rest").to_numpy()[:, None] * rests[top] + left.column("extra").to_numpy()[:, None] + SLACK
                i, k = np.nonzero((value > -2.0) & (bound >= best[:, None] - 10.0**-PLACES))
                count += np.bincount(i, minlength=len(count))
                self._take(dense, i, top[i, k], keys, lists, best, who)

            return better

        met = ref.select("ref_key", "terms", "norm").mapInArrow(lambda batches: self._run(batches, files, slab), "query_key long, cosine double, ref_key long, multiplied long")
        return self._best(met)

    @staticmethod
    def _best(met: DataFrame) -> DataFrame:
        found = F.when(F.col("ref_key").isNotNull(), F.struct("cosine", -F.col("ref_key")))
        return met.groupBy("query_key").agg(F.max("cosine").alias("cosine"), F.max_by("ref_key", found).alias("ref_key"), F.sum("multiplied").alias("multiplied"))

    def exact(self, ref: DataFrame, files: list[str], known: list[str]) -> DataFrame:
        """query_key, cosine, ref_key and multiplied (pairs that the bound left open) of the best partner of each query.

        ``known``: files with query_key and the cosine of some partner. A query with many open partners is multiplied with
        all of them at once in 32 bits, and in full with those that may still be the best.
        """

        def run(batches):
            tables = list(_read(known, 1 << 20))
            there = np.concatenate([t.column("query_key").to_numpy() for t in tables] or [np.zeros(0, np.int64)])
            value = np.concatenate([pc.fill_null(t.column("cosine"), -1.0).to_numpy() for t in tables] or [np.zeros(0)])
            order = np.argsort(there)
            there, value = there[order], value[order]

            def least_of(asked: np.ndarray) -> np.ndarray:
                if not len(there):
                    return np.full(len(asked), -1.0)
                at = np.minimum(np.searchsorted(there, asked), len(there) - 1)
                return np.where(there[at] == asked, value[at], -1.0)

            def slab(right: pa.Table):
                keys, (heads, *lists) = right.column("ref_key").to_numpy(), _projected(self.weights, right.column("terms").to_pylist(), right.column("norm").to_numpy(), self.basis.columns(self.basis.shape[1]))
                rests = _rests(heads)

                def better(left, q, dense, best, who, count):
                    own, rest, extra = _own(left), left.column("rest").to_numpy(), left.column("extra").to_numpy()[:, None] + np.float32(SLACK)
                    least = least_of(left.column("query_key").to_numpy())
                    for k in range(0, len(keys), 1024):
                        some = slice(k, k + 1024)
                        bound = q @ heads[some].T
                        bound += np.outer(rest, rests[some])
                        bound += extra
                        open_ = bound >= (np.maximum(best, least) - 10.0**-PLACES)[:, None]
                        open_ &= own != keys[some]
                        n = open_.sum(axis=1)
                        count += n
                        if len(many := np.flatnonzero(n > MANY * open_.shape[1])):
                            product = np.where(open_[many], dense[many].astype(np.float32) @ _dense(lists[0][some], lists[1][some], self.basis.shape[0], np.float32).T, -1.0)
                            open_[many] = (product > -1.0) & (product >= np.maximum(np.maximum(best, least)[many], product.max(axis=1))[:, None] - 1e-5)
                        i, j = np.nonzero(open_)
                        self._take(dense, i, j + k, keys, lists, best, who)

                return better

            yield from self._run(batches, files, slab)

        met = ref.select("ref_key", "terms", "norm").mapInArrow(run, "query_key long, cosine double, ref_key long, multiplied long")
        return self._best(met)


def nearest(query: DataFrame, ref: DataFrame, weights: Weights, exact: bool = True, rank: int = 1536, block: int = 512, part: int = 8192) -> DataFrame:
    """query_key, cosine, nearest and multiplied of ``query`` (query_key, own, terms, norm), against ``ref`` (ref_key, terms, norm).

    own: a ref_key that is no partner, or null. exact: False gives the best of a few partners by head (512 coordinates) in
    each part of the reference instead; all heads meet, so that no bucket is cut.
    """
    if not ref.take(1):
        return query.select("query_key", F.lit(None).cast("double").alias("cosine"), F.lit(None).cast("long").alias("nearest"), F.lit(0).cast("long").alias("multiplied"))
    basis = Basis.fitted(ref, weights, rank if exact else min(rank, 512))
    files = dealt(with_short_heads(query, weights, basis), 4096).inputFiles()
    search = Search(weights, basis, block, part)
    if not exact:
        return search.likely(ref, files, 4).withColumnRenamed("ref_key", "nearest")
    known = written(search.first(ref, files)).inputFiles()
    return search.exact(ref, files, known).withColumnRenamed("ref_key", "nearest")
