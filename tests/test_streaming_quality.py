"""Metrics kept up to date batch by batch, in any order of rows, against those of all rows at once."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from tidegauge.operators import aggregates as A
from tidegauge.schema import OBSERVATIONS
from tidegauge.streaming import daily, quality


def test_stream_equals_batch_in_any_order(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [("S", f"s{int(rng.integers(0, 4))}", datetime(2024, 1, 1) + timedelta(minutes=int(rng.integers(0, 9 * 24 * 4)) * 15), [0.0, 1.0, 1.0, float("nan"), None, 2.5][int(rng.integers(0, 6))]) for _ in range(600)]
    rows += rows[:20] + [("S", "alone", datetime(2024, 1, 3), 1.0), ("S", "twice", datetime(2024, 1, 3), 1.0), ("S", "twice", datetime(2024, 1, 3), 1.0), ("T", "s1", datetime(2024, 1, 5, 23, 59), 1.0), ("T", "s1", datetime(2024, 1, 7, 0, 1), 1.0), ("T", "s1", None, 3.0)]
    order = rng.permutation(len(rows))
    for part in np.array_split(order, 4):
        spark.createDataFrame([rows[k] for k in part], OBSERVATIONS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(OBSERVATIONS).parquet(str(tmp_path / "in"))
        got = quality.run_available(spark, stream, str(tmp_path / "out"))
    want = A.quality(spark.createDataFrame(rows, OBSERVATIONS)).select(*got.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and got.count() == 7


def test_ends_of_streamed_windows(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet").select(F.lit("S").alias("site_id"), F.col("user_id").cast("string").alias("stream_id"), "ts", "value")
    events.write.parquet(str(tmp_path / "in"))
    streamed = daily.run_available(spark, spark.readStream.schema(OBSERVATIONS).parquet(str(tmp_path / "in")), str(tmp_path / "out"), "week", "10000 days")
    got = quality.with_ends(streamed, "week").select("site_id", "stream_id", "window_start", "window_end", "count", "mean_value")
    want = A.summarize(events, "week").select(*got.columns)
    assert got.count() == want.count() > 0 and got.exceptAll(want).isEmpty()
