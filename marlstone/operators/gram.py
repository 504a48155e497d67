"""Ridge from weighted Gram sums: one pass over the rows gives the sums of every group, fits need no rows.

A group's sums are its weight, the means of features and label, and their scatter about the means; two groups' sums add up
to the sums of both, and one group's can be taken off, so leave-one-fold-out fits come from the total.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Sums = tuple[int, float, np.ndarray, np.ndarray]
_SUMS = [T.StructField("n", T.LongType()), T.StructField("w", T.DoubleType()), T.StructField("mean", T.BinaryType()), T.StructField("scatter", T.BinaryType())]


def sums_of(z: np.ndarray, w: np.ndarray) -> Sums:
    """Rows, weight, means and scatter of rows ``z`` (features and label)."""
    total = float(w.sum())
    mean = w @ z / total
    d = z - mean
    return len(z), total, mean, (d * w[:, None]).T @ d


def added(a: Sums, b: Sums) -> Sums:
    total, d = a[1] + b[1], b[2] - a[2]
    return a[0] + b[0], total, a[2] + d * (b[1] / total), a[3] + b[3] + np.outer(d, d) * (a[1] * b[1] / total)


def taken_off(a: Sums, b: Sums) -> Sums | None:
    """``a`` without its part ``b``; None if nothing is left."""
    n, rest = a[0] - b[0], a[1] - b[1]
    if n <= 0 or rest <= 0:
        return None
    mean = (a[1] * a[2] - b[1] * b[2]) / rest
    d = b[2] - mean
    return n, rest, mean, a[3] - b[3] - np.outer(d, d) * (rest * b[1] / a[1])


def solved(s: Sums, alpha: float) -> tuple[float, np.ndarray]:
    """(intercept, coefficients) that minimise sum of w (y - a - x b)^2 + alpha b^2; the shortest b of several."""
    k = len(s[2]) - 1
    b = np.linalg.lstsq(s[3][:k, :k] + alpha * np.eye(k), s[3][:k, k], rcond=None)[0]
    return float(s[2][k] - s[2][:k] @ b), b


def _packed(s: Sums) -> tuple[int, float, bytes, bytes]:
    return s[0], s[1], s[2].tobytes(), s[3].tobytes()


def _unpacked(n: int, w: float, mean: bytes, scatter: bytes) -> Sums:
    m = np.frombuffer(mean)
    return n, w, m, np.frombuffer(scatter).reshape(len(m), len(m))


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(to_arrow_schema(schema))], names=schema.names)


def gram_sums(df: DataFrame, features: Sequence[str], y: str, weight: str, by: Sequence[str] = ()) -> DataFrame:
    """by, n, w, mean and scatter (packed 64-bit floats): the sums of each group; rows with a null or non-finite number or a
    weight that is not above 0 are left out. A task sends one row for each of its groups, which are added as they come; a null
    key is a group. No rows give no groups."""
    by, k = list(by), len(by)
    numbers = [*features, y, weight]
    schema = T.StructType([*(df.schema[b] for b in by), *_SUMS])

    def codes(batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros(batch.num_rows, np.int64)
        for c in range(k):
            d = batch.column(c).dictionary_encode()
            out = out * (len(d.dictionary) + 1) + d.indices.fill_null(len(d.dictionary)).to_numpy()
        return out

    def partial(batches):
        held: dict[tuple, Sums] = {}
        for batch in batches:
            z = np.column_stack([batch.column(k + c).to_numpy(zero_copy_only=False).astype(np.float64) for c in range(len(numbers))]) if batch.num_rows else np.zeros((0, len(numbers)))
            group = codes(batch)
            good = np.isfinite(z).all(axis=1) & (z[:, -1] > 0)
            for g in np.unique(group[good]):
                at = np.flatnonzero((group == g) & good)
                key = tuple(batch.column(c)[int(at[0])].as_py() for c in range(k))
                s = sums_of(z[at, :-1], z[at, -1])
                held[key] = added(held[key], s) if key in held else s
        if held:
            yield _batch([(*key, *_packed(s)) for key, s in held.items()], schema)

    def whole(batches):
        held: tuple | None = None
        total: Sums | None = None
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in range(k + 4)), strict=True)
            for row in rows:
                s = _unpacked(*row[k:])
                if total is not None and row[:k] == held:
                    total = added(total, s)
                else:
                    if total is not None:
                        yield _batch([(*held, *_packed(total))], schema)
                    held, total = row[:k], s
        if total is not None:
            yield _batch([(*held, *_packed(total))], schema)

    parts = df.select(*by, *(F.col(c).cast("double").alias(f"__{i}") for i, c in enumerate(numbers))).mapInArrow(partial, schema)
    dealt = parts.repartition(*by).sortWithinPartitions(*by) if by else parts.repartition(1)  # one row a task
    return dealt.mapInArrow(whole, schema)


def ridge_by_group(sums: DataFrame, by: Sequence[str] = (), alpha: float = 1.0) -> DataFrame:
    """by, n, intercept, coefficients of each group's ridge."""
    by, k = list(by), len(by)
    schema = T.StructType([*(sums.schema[b] for b in by), _SUMS[0], T.StructField("intercept", T.DoubleType()), T.StructField("coefficients", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in range(k + 4)), strict=True):
                a, b = solved(_unpacked(*row[k:]), alpha)
                out.append((*row[:k], row[k], a, b.tolist()))
            yield _batch(out, schema)

    return sums.select(*by, "n", "w", "mean", "scatter").mapInArrow(run, schema)


def ridge_folds(sums: DataFrame, fold: str, by: Sequence[str] = (), alpha: float = 1.0) -> DataFrame:
    """by, fold, n, intercept, coefficients: for each fold the ridge of all others, from one set of sums by (by, fold).

    A fold that holds all rows of its group has no fit and no row.
    """
    by = list(by)
    schema = T.StructType([*(sums.schema[b] for b in by), sums.schema[fold], _SUMS[0], T.StructField("intercept", T.DoubleType()), T.StructField("coefficients", T.ArrayType(T.DoubleType()))])

    def run(table: pa.Table) -> pa.Table:  # one row a fold
        rows = table.to_pylist()
        parts = [_unpacked(r["n"], r["w"], r["mean"], r["scatter"]) for r in rows]
        total, out = reduce(added, parts), []
        for r, s in zip(rows, parts, strict=True):
            rest = taken_off(total, s)
            if rest:
                a, b = solved(rest, alpha)
                out.append((*(r[c] for c in by), r[fold], rest[0], a, b.tolist()))
        return pa.Table.from_batches([_batch(out, schema)])

    return sums.select(*by, fold, "n", "w", "mean", "scatter").groupBy(*by).applyInArrow(run, schema)


def predict_linear(df: DataFrame, models: DataFrame, features: Sequence[str], by: Sequence[str] = (), name: str = "prediction") -> DataFrame:
    """Adds the prediction of the row's group's model; null where there is none or a feature is null."""
    fits = models.select(*(F.col(b).alias(f"__m_{b}") for b in by), "intercept", "coefficients")
    out = df.join(fits, reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"__m_{b}")) for b in by]), "left") if by else df.crossJoin(F.broadcast(fits))  # one model
    value = reduce(lambda a, b: a + b, [F.col(c) * F.get("coefficients", F.lit(i)) for i, c in enumerate(features)], F.col("intercept"))
    return out.withColumn(name, value).drop("intercept", "coefficients", *(f"__m_{b}" for b in by))
