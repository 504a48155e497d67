"""Incremental scoring: a file stream through a scoring function, each row once, resumable from its checkpoint."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from marlstone.functions.expr import finite


@dataclass(frozen=True)
class Run:
    """What one run of a stream did: rows read, rows written, rows dropped as repeats and as too late."""

    read: int
    written: int
    repeated: int
    late: int


def _told(query: StreamingQuery, written: int) -> Run:
    """From the progress of a query that has ended; rows written are counted as they are written."""
    states = [(op["numRowsDroppedByWatermark"], op.get("customMetrics") or {}) for p in query.recentProgress for op in p["stateOperators"]]
    return Run(sum(int(p["numInputRows"]) for p in query.recentProgress), written, sum(int(m.get("numDroppedDuplicateRows", 0)) for _, m in states), sum(int(n) for n, _ in states))


def score_stream(spark: SparkSession, source: str, schema: T.StructType, uid: str, score: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, time: str | None = None, late: str = "1 day", metrics: tuple[str, str, str, str] | None = None) -> Run:
    """Scores what has arrived below ``source`` since the last run and appends it to ``sink``.

    A repeated uid is scored once: with ``time`` the state of uids is dropped after ``late`` and rows behind the newest time
    by more are left out, else it is kept for good. Rows without uid are left out. Each batch is written under its own
    number, so a repeated batch replaces itself. metrics: (path, endpoint, y, p); each batch then also leaves its sums by
    endpoint there, under its number too, for ``running_metrics``.
    """
    rows = spark.readStream.schema(schema).parquet(source).where(F.col(uid).isNotNull())
    if time:
        rows = rows.withColumn(time, F.col(time).cast("timestamp"))  # watermarks take no other type
    unique = rows.withWatermark(time, late).dropDuplicatesWithinWatermark([uid]) if time else rows.dropDuplicates([uid])
    counts: dict[int, int] = {}

    def write(batch: DataFrame, number: int) -> None:
        out = f"{sink}/part={number}"
        score(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(out)
        scored = batch.sparkSession.read.parquet(out)
        counts[number] = scored.count()
        if metrics:
            path, endpoint, y, p = metrics
            batch_sums(scored, endpoint, y, p).write.mode("overwrite").parquet(f"{path}/part={number}")

    query = unique.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return _told(query, sum(counts.values()))


def batch_sums(scored: DataFrame, endpoint: str, y: str, p: str) -> DataFrame:
    """endpoint, n and the sums that the metrics need, over rows with finite label and prediction."""
    e, a, b = F.col(y) - F.col(p), F.col(y), F.col(p)
    sums = {"sum_y": a, "sum_p": b, "sum_yy": a * a, "sum_pp": b * b, "sum_yp": a * b, "sse": e * e, "sae": F.abs(e)}
    return scored.where(finite(y, p)).groupBy(F.col(endpoint).alias("endpoint")).agg(F.count("*").alias("n"), *(F.sum(v).alias(k) for k, v in sums.items()))


def running_metrics(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """endpoint, n, rmse, mae, r2, pearson of all batches so far (up to number ``upto``), from their sums; a row for all
    endpoints is called ``overall``. A batch that was repeated counts once, since it replaced its sums."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/part=*")
    rows = rows.where(F.col("part") <= upto) if upto is not None else rows
    names = [c for c in rows.columns if c not in ("endpoint", "part")]
    total = rows.select(F.explode(F.array(F.lit("overall"), F.coalesce(F.col("endpoint").cast("string"), F.lit("NA")))).alias("endpoint"), *names).groupBy("endpoint").agg(*(F.sum(c).alias(c) for c in names))
    n = F.col("n")
    yy, pp, yp = (F.col(f"sum_{a}{b}") - F.col(f"sum_{a}") * F.col(f"sum_{b}") / n for a, b in ("yy", "pp", "yp"))
    return total.select("endpoint", "n", F.sqrt(F.col("sse") / n).alias("rmse"), (F.col("sae") / n).alias("mae"), F.when((n >= 2) & (yy > 0), 1 - F.col("sse") / yy).alias("r2"), F.when((yy > 0) & (pp > 0), yp / F.sqrt(yy * pp)).alias("pearson"))


def windowed_errors(stream: DataFrame, time: str, endpoint: str, error: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Per window and endpoint: n and mean error; windows close ``late`` after the newest row."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width), endpoint).agg(F.count("*").alias("n"), F.avg(error).alias("mean_error"))


def windowed_errors_stream(spark: SparkSession, source: str, schema: T.StructType, time: str, endpoint: str, error: str, sink: str, checkpoint: str, width: str = "1 day", late: str = "1 hour") -> Run:
    """Takes what has arrived below ``source`` into the windows' running sums, which are the stream's state.

    Each batch leaves the windows that it changed below ``sink`` under its number (``latest_windows`` reads them). Rows of
    windows that closed ``late`` before the newest row are dropped and told in the result.
    """
    counts: dict[int, int] = {}

    def write(batch: DataFrame, number: int) -> None:
        out = f"{sink}/part={number}"
        batch.write.mode("overwrite").parquet(out)
        counts[number] = batch.sparkSession.read.parquet(out).count()

    windows = windowed_errors(spark.readStream.schema(schema).parquet(source), time, endpoint, error, width, late)
    query = windows.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return _told(query, sum(counts.values()))


def latest_windows(spark: SparkSession, sink: str, endpoint: str) -> DataFrame:
    """window, endpoint, n, mean_error: of each window what the last batch that changed it left."""
    rows = spark.read.option("basePath", sink).parquet(f"{sink}/part=*")
    last = rows.groupBy("window", endpoint).agg(F.max_by(F.struct("n", "mean_error"), "part").alias("x"))
    return last.select("window", endpoint, "x.n", "x.mean_error")
