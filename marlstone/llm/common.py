"""Helpers shared by the operators of this subpackage: the shared folder, and words as 64-bit hashes."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.shared import shared_path, written

shared_dir, staged = shared_path, written
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def freed(df: DataFrame, name: str = "table") -> DataFrame:
    """``staged``, packed tighter, after which the shuffle files that making the table took are removed: it replaces them."""
    conf, path = df.sparkSession.conf, f"{shared_dir(df.sparkSession)}/{name}"
    before = conf.get(_FREE, None)
    conf.set(_FREE, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        conf.unset(_FREE) if before is None else conf.set(_FREE, before)


def join_hot(many: DataFrame, one: DataFrame, key: str | list[str], rows: str, total: int, most: int = 256) -> DataFrame:
    """Inner join of ``many`` with ``one``, whose keys are unique and whose column ``rows`` tells how many rows of ``many``
    each key has. Keys with at least ``total / most`` rows, of which there cannot be more than ``most``, are broadcast, so that
    no task gets all rows of a hot key; the others are shuffled. ``total``: rows of ``many`` with a key."""
    keys = [key] if isinstance(key, str) else key
    hot, cold = one.where(F.col(rows) * most >= total), one.where(F.col(rows) * most < total)
    return many.join(F.broadcast(hot), keys).unionByName(many.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys))

def slices(batch: pa.RecordBatch, column: int, chars: int = 4_000_000, rows: int = 4096):
    """The batch in runs of at most so many rows and about so many bytes of ``column``."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column).cast(pa.large_string())), 0).to_numpy(zero_copy_only=False)
    ends, first = np.cumsum(sizes), 0
    while first < batch.num_rows:
        base = ends[first] - sizes[first]
        last = min(first + rows, max(first + 1, int(np.searchsorted(ends, base + chars, "right"))))
        yield batch.slice(first, last - first)
        first = last


# --- words as hashes -------------------------------------------------------------------------------------------------

_BYTES = np.random.default_rng(20240607).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
#: ASCII that is neither letter nor digit separates words; bytes of other characters belong to words.
SEPARATOR = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (a new array)."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            full = np.full(max(n, BLOCK + 1), base, np.uint64)
            full[0] = 1
            _POWERS[name] = np.cumprod(full, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def text_array(column: pa.ChunkedArray | pa.Array, lower: bool = True) -> pa.Array:
    """Nulls become empty texts; optionally lower case."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    array = pc.fill_null(array.cast(pa.large_string()), "")
    return pc.utf8_lower(array) if lower else pc.utf8_slice_codeunits(array, 0) if array.offset else array


def word_blocks(texts: pa.Array, separator: np.ndarray = SEPARATOR):
    """Yields (first, last, hashes, counts, starts, ends) for runs of texts of about a MB, or of one longer text.

    hashes: a 64-bit hash for each word in order; counts: words of each text; starts and ends: byte positions in
    the block, with the block's first byte at 0.
    """
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < n:
        last = min(n, first + 32_768, max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK, "right")) - 1))
        block = data[offsets[first] : offsets[last]]
        bounds = offsets[first : last + 1] - offsets[first]
        yield (first, last, *_words(block, bounds, separator))
        first = last


def _words(block: np.ndarray, bounds: np.ndarray, separator: np.ndarray):
    size = len(block)
    if not size:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), np.zeros(len(bounds) - 1, np.int64), none, none
    inside = ~separator[block]
    edge = np.zeros(size + 1, bool)
    edge[bounds] = True
    before = np.concatenate(([False], inside[:-1])) & ~edge[:size]
    after = np.concatenate((inside[1:], [False])) & ~edge[1:]
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    counts = np.diff(np.searchsorted(starts, bounds))
    return hash_runs(block, starts, ends), counts, starts, ends


def hash_runs(block: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each run, wherever in the block it stands."""
    up, down = _powers(len(block) + 1)
    sums = np.zeros(len(block) + 1, np.uint64)
    np.cumsum(_BYTES[block] * up[: len(block)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def rolling(block: np.ndarray, size: int) -> np.ndarray:
    """``hash_runs`` of the ``size`` bytes from each place on."""
    up, down = _powers(len(block) + 1)
    sums = np.zeros(len(block) + 1, np.uint64)
    np.cumsum(_BYTES[block] * up[: len(block)], out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * down[: len(block) - size + 1])


def release() -> None:
    """Hands freed memory back to the system: a Python worker is kept for later stages, with what it holds."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


#: Odd multipliers that tell the places in a shingle apart.
PLACES = np.random.default_rng(977).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(hashes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each run of ``size`` words, index of its text, index of its first word); shorter texts give one run."""
    begins = np.concatenate(([0], np.cumsum(counts)[:-1])) if len(counts) else np.zeros(0, np.int64)
    runs = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(counts)), runs)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)
    at = begins[owner] + within
    total = np.zeros(len(at), np.uint64)
    left = counts[owner] - within
    padded = np.concatenate((hashes, np.zeros(size, np.uint64)))
    for k in range(size):
        total += np.where(left > k, padded[at + k], np.uint64(k + 1)) * PLACES[k]
    return mix(total), owner, at


def bucket_df(df: DataFrame, text: str, bits: int, separator: str = "words") -> tuple[np.ndarray, int]:
    """Document frequency of words over all rows of ``df``, in 2**bits hashed buckets, and the number of rows.

    Every row counts. The table has a fixed size whatever the corpus: a rare word reads as the mean of its bucket,
    whose share of the documents settles as the corpus grows. Each task sends its table in slices of 4,096 buckets;
    Spark adds them up slice by slice, so that no task holds more than tasks x 16 KB.
    """
    sep = SEPARATOR if separator == "words" else SPACE
    width = min(4096, 1 << bits)

    def count(batches):
        table, rows = np.zeros(1 << bits, np.int64), 0
        for batch in batches:
            for part in slices(batch, 0):
                for first, last, hashes, counts, _, _ in word_blocks(text_array(part.column(0)), sep):
                    owner = np.repeat(np.arange(last - first, dtype=np.int64), counts)
                    keys = np.unique((owner << bits) | (hashes >> np.uint64(64 - bits)).astype(np.int64))
                    table += np.bincount(keys & ((1 << bits) - 1), minlength=1 << bits)
            rows += batch.num_rows
        for k in range(0, 1 << bits, width):
            part = table[k : k + width]
            at = np.flatnonzero(part)
            yield pa.RecordBatch.from_pydict(
                {"slice": [k], "at": [at.astype(np.int32)], "n": [part[at]], "rows": [rows if not k else 0]},
                schema=pa.schema([("slice", pa.int32()), ("at", pa.list_(pa.int32())), ("n", pa.list_(pa.int64())), ("rows", pa.int64())]),
            )
        release()

    def add(key, table):
        total = np.zeros(width, np.int64)
        for at, n in zip(table.column("at"), table.column("n"), strict=True):
            np.add.at(total, at.values.to_numpy(), n.values.to_numpy())
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([total], pa.list_(pa.int64())), "rows": pa.array([sum(table.column("rows").to_pylist())], pa.int64())})

    parts = df.select(text).mapInArrow(count, "slice int, at array<int>, n array<long>, rows long")
    sums = parts.groupBy("slice").applyInArrow(add, "slice int, n array<long>, rows long").toArrow().to_pydict()
    out, total = np.zeros(1 << bits, np.int64), 0
    for k, n, rows in zip(sums["slice"], sums["n"], sums["rows"], strict=True):
        out[k : k + width] = n
        total += rows
    return out, total
