"""Queries over Structured Streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidegauge.plans import views as V
from tidegauge.plans.registry import query
from tidegauge.streaming import daily, quality
from tidegauge.tables import shared_folder


@query(
    "streaming_daily",
    """SELECT site_id, stream_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, CAST(date_trunc('day', ts) AS TIMESTAMP) + INTERVAL 1 DAY AS window_end, count(*) AS count,
    CAST(sum(CAST(value AS DECIMAL(20, 6))) AS DOUBLE) / count(*) AS mean_value, min(value) AS min_value, max(value) AS max_value FROM obs_fine GROUP BY 1, 2, 3""",
)
def streaming_daily(spark, d):
    events = V.table(spark, d, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    obs = stream.select(F.concat(F.lit("SITE_"), (F.col("user_id") % 3).cast("string")).alias("site_id"), F.concat(F.lit("usr_"), F.col("user_id").cast("string")).alias("stream_id"), "ts", "value")
    return daily.run_available(spark, obs, f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}")


@query("streaming_quality", "SELECT * FROM fine_quality")
def streaming_quality(spark, d):
    """Metrics of all fine streams from a stream of their observations."""
    events = V.table(spark, d, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    obs = stream.select(F.concat(F.lit("SITE_"), (F.col("user_id") % 3).cast("string")).alias("site_id"), F.concat(F.lit("usr_"), F.col("user_id").cast("string")).alias("stream_id"), "ts", "value")
    return quality.run_available(spark, obs, f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}")
