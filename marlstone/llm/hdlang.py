"""Language ID by hyperdimensional profiles.

Each letter has a random +1/-1 vector; an n-gram is the product of its letters' vectors, each rotated by its place;
a text is the sum of its n-grams' vectors, a language the sum of its texts'. A text's language is the prototype with
the largest cosine.
"""

from __future__ import annotations

import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import release, slices

UNKNOWN = "und"
#: Characters of a text looked at at once.
STRIDE = 1 << 20
#: More labels than this are an error: their prototypes (8 KB each) travel to every task, 16 partial sums of each to the driver.
MOST_LANGUAGES = 1_000


@lru_cache(1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


class Space:
    """n-gram vectors of one seed, made when first met; the table starts anew when its ``limit`` rows are full."""

    def __init__(self, dims: int, n: int, seed: int, limit: int = 1 << 15):
        self.dims, self.n, self.seed, self.limit = dims, n, seed, limit
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.table = np.zeros((limit, dims), np.int8)

    def letter(self, code: int) -> np.ndarray:
        if (v := self.letters.get(code)) is None:
            if len(self.letters) >= 4096:
                self.letters = {}
            bits = np.random.default_rng([self.seed, code]).integers(0, 2, self.dims, dtype=np.int8)
            self.letters[code] = v = bits * np.int8(2) - np.int8(1)
        return v

    def row(self, gram: int) -> int:
        if (k := self.rows.get(gram)) is None:
            k = self.rows[gram] = len(self.rows)
            codes = [(gram >> (21 * j)) & 0x1FFFFF for j in range(self.n)]
            bound = np.ones(self.dims, np.int8)
            for place, code in enumerate(codes):
                bound *= np.roll(self.letter(code), place)
            self.table[k] = bound
        return k

    def vector(self, text: str | None) -> np.ndarray | None:
        """The text's vector; None if it has no letter. Case, digits and marks do not count; words are set apart by one blank.

        Long texts are read STRIDE characters at a time; the last letters of one stride begin the next.
        """
        text, total, carried, met = text or "", np.zeros(self.dims, np.float32), np.full(1, 32, np.int64), False
        for k in range(0, len(text), STRIDE):
            codes = np.frombuffer(text[k : k + STRIDE].lower().encode("utf-32-le", "replace"), "<u4")
            codes = np.where(_is_letter()[codes], codes, 32).astype(np.int64)
            met = met or bool((codes != 32).any())
            ending = [np.full(1, 32, np.int64)] if k + STRIDE >= len(text) else []
            codes = np.concatenate((carried, codes, *ending))
            keep = np.ones(len(codes), bool)
            keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
            codes = codes[keep]
            if ending and met and k == 0 and len(codes) < self.n:
                codes = np.concatenate((codes, np.full(self.n - len(codes), 32)))
            self._add(codes, total)
            carried = codes[max(0, len(codes) - self.n + 1) :]
        return total if met else None

    def _add(self, codes: np.ndarray, total: np.ndarray) -> None:
        width = len(codes) - self.n + 1
        if width < 1:
            return
        grams = sum(codes[j : j + width] << (21 * j) for j in range(self.n))
        grams, counts = np.unique(grams, return_counts=True)
        for k in range(0, len(grams), 2048):
            part = grams[k : k + 2048].tolist()
            if len(self.rows) + len(part) > self.limit:
                self.rows = {}
            at = np.fromiter(map(self.row, part), np.int64, len(part))
            total += counts[k : k + 2048].astype(np.float32) @ self.table[at].astype(np.float32)


@lru_cache(2)
def space(dims: int, n: int, seed: int) -> Space:
    return Space(dims, n, seed)


def fit_prototypes(train: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = 2000, dims: int = 1024, n: int = 3, seed: int = 11) -> dict[str, np.ndarray]:
    """A unit vector for each language of ``train``, from about ``per_language`` of its texts (all, if it has fewer).

    The sample is drawn by a hash of ``key``, so it is the same however the table is partitioned. Rows with a null
    language, null text or no letter teach nothing; more than MOST_LANGUAGES labels are an error. What reaches the driver is at most 16 vectors for each language.
    """
    rows = train.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 40)).alias("draw"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("size")).limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    table = train.sparkSession.createDataFrame([tuple(r) for r in sizes], "lang string, size long")
    chosen = rows.join(F.broadcast(table), "lang").where(F.col("draw").cast("double") < F.lit(float(per_language) * (1 << 40)) / F.col("size"))  # a product of bigints would overflow

    def bundle(batches):
        made, sums = space(dims, n, seed), {}
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (v := made.vector(value)) is not None:
                    sums[name] = sums.get(name, 0) + v / np.linalg.norm(v)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(sums), pa.string()), "v": pa.array(list(sums.values()), pa.list_(pa.float32()))})
        release()

    parts = chosen.select("lang", "text").repartition(16).mapInArrow(bundle, "lang string, v array<float>")
    out: dict[str, np.ndarray] = {}
    for row in sorted(parts.collect(), key=lambda r: (r["lang"], r["v"])):
        out[row["lang"]] = out.get(row["lang"], 0) + np.array(row["v"], np.float64)
    return {k: v / np.linalg.norm(v) for k, v in sorted(out.items())}


def identify_language(df: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", dims: int = 1024, n: int = 3, seed: int = 11) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (cosine with the nearest prototype, 0 to 1).

    A null text, or one without a letter, gives ``und`` and 0; so does everything if no language was learnt. Ties go to
    the language first by name. Columns already named so are replaced; nothing but ``text`` is read.
    """
    keep = [c for c in df.columns if c not in ("lang_pred", "score")]
    df = df.select(*(F.col(f"`{c}`") for c in keep))
    schema = T.StructType([*df.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    names, at = list(prototypes), keep.index(text)
    matrix = np.array(list(prototypes.values()))

    def run(batches):
        made = space(dims, n, seed)
        for whole in batches:
            for batch in slices(whole, at):
                found, scores = [], []
                for value in batch.column(at):
                    v = made.vector(value.as_py()) if names else None
                    if v is None:
                        found.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    cosines = matrix @ v.astype(np.float64) / max(float(np.linalg.norm(v)), 1e-30)
                    best = int(np.argmax(cosines))
                    found.append(names[best])
                    scores.append(float(min(1.0, max(0.0, cosines[best]))))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])
        release()

    return df.mapInArrow(run, schema)
