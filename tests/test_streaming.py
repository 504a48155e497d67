"""Streams in several runs: repeated and late rows are dropped and told, sums go on where they stopped."""

import math

from pyspark.sql import functions as F

from marlstone.streaming import scoring


def test_runs_tell_repeats_and_late_rows(spark, tmp_path):
    src, out, mark, sums = (str(tmp_path / n) for n in ("in", "out", "mark", "sums"))
    schema = "uid long, endpoint string, y double, p double, t timestamp_ntz"
    put = lambda rows: spark.createDataFrame(rows, "uid long, endpoint string, y double, p double, t string").withColumn("t", F.col("t").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(src)
    run = lambda: scoring.score_stream(spark, src, spark.createDataFrame([], schema).schema, "uid", lambda b: b.withColumn("q", F.col("p") * 2), out, mark, time="t", late="2 days", metrics=(sums, "endpoint", "y", "p"))
    put([(1, "a", 1.0, 2.0, "2024-01-10 00:00:00"), (2, "b", 3.0, 3.0, "2024-01-09 00:00:00"), (2, "b", 3.0, 3.0, "2024-01-09 00:00:00"), (None, "b", 9.0, 9.0, "2024-01-09 00:00:00")])
    first = run()
    assert (first.read, first.written, first.repeated, first.late) == (4, 2, 1, 0)
    put([(1, "a", 1.0, 2.0, "2024-01-10 00:00:00"), (3, "a", 5.0, 4.0, "2024-01-11 00:00:00"), (4, "b", 8.0, 8.0, "2024-01-01 00:00:00"), (5, None, 2.0, None, "2024-01-11 00:00:00")])
    second = run()
    assert (second.read, second.written, second.late) == (4, 2, 1) and second.repeated == 1
    assert sorted(r.uid for r in spark.read.parquet(out).collect()) == [1, 2, 3, 5]
    got = {r.endpoint: r for r in scoring.running_metrics(spark, sums).collect()}
    assert set(got) == {"overall", "a", "b"} and (got["a"].n, got["b"].n, got["overall"].n) == (2, 1, 3)
    assert math.isclose(got["a"].rmse, 1.0) and got["b"].r2 is None and math.isclose(got["overall"].rmse, math.sqrt(2 / 3))
    assert math.isclose(got["overall"].r2, 1 - 2 / 8) and run().read == 0
    begun = {r.endpoint: r.n for r in scoring.running_metrics(spark, sums, upto=0).collect()}
    assert begun == {"overall": 2, "a": 1, "b": 1}


def test_windows_close_for_late_rows(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    put = lambda rows: spark.createDataFrame(rows, "t string, e string, v double").withColumn("t", F.col("t").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(src)
    schema = spark.createDataFrame([], "t timestamp_ntz, e string, v double").schema
    run = lambda: scoring.windowed_errors_stream(spark, src, schema, "t", "e", "v", out, mark, late="6 hours")
    put([("2024-01-01 10:00:00", "a", 1.0), ("2024-01-02 05:00:00", "a", 2.0), ("2024-01-02 05:00:00", "b", 7.0)])
    assert run().late == 0
    put([("2024-01-01 23:00:00", "a", 3.0), ("2024-01-03 12:00:00", "a", 5.0)])  # the first day is still open
    assert run().late == 0
    put([("2024-01-01 12:00:00", "a", 100.0), ("2024-01-02 23:59:00", "a", 100.0), ("2024-01-03 01:00:00", "a", 9.0)])
    assert run().late == 2  # days one and two closed six hours after their ends
    got = {(str(r.window.start)[:10], r.e): (r.n, r.mean_error) for r in scoring.latest_windows(spark, out, "e").collect()}
    assert got == {("2024-01-01", "a"): (2, 2.0), ("2024-01-02", "a"): (1, 2.0), ("2024-01-02", "b"): (1, 7.0), ("2024-01-03", "a"): (2, 7.0)}
