"""Joins along time: rows in windows, exact instants, nearest instants."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.columns import seconds_between


def rows_in_windows(obs: DataFrame, windows: DataFrame, key: str = "stream_id") -> DataFrame:
    """Every window row with every observation of its stream in [window_start, window_end), windows without one too (null ts and value).

    A window is put once on each of its days, so that stream and day are keys of an equi-join; a window of years costs as many rows as days.
    """
    days = F.explode(F.sequence(F.to_date("window_start"), F.to_date("window_end")))
    daily = windows.select("*", days.alias("_day"))
    points = obs.select(F.col(key).alias("_key"), F.to_date("ts").alias("_date"), "ts", "value")
    inside = (F.col("ts") >= F.col("window_start")) & (F.col("ts") < F.col("window_end"))
    hits = daily.join(points, (F.col(key) == F.col("_key")) & (F.col("_day") == F.col("_date")) & inside).drop("_day", "_key", "_date")
    none = windows.join(hits.select("request_id").distinct(), "request_id", "left_anti")
    return hits.unionByName(none, allowMissingColumns=True)


def exact(obs: DataFrame, probes: DataFrame) -> DataFrame:
    """probe_id, stream_id, probe_ts, found, value: the observation at the very instant, the least value where there are several."""
    # Of other instants nothing is asked.
    asked = obs.join(probes.select("stream_id", F.col("probe_ts").alias("ts")).distinct(), ["stream_id", "ts"], "left_semi")
    at = asked.groupBy("stream_id", "ts").agg(F.min("value").alias("value"))
    joined = probes.join(at, (probes.stream_id == at.stream_id) & (probes.probe_ts == at.ts), "left").drop(at.stream_id)
    return joined.select("probe_id", "stream_id", "probe_ts", F.col("ts").isNotNull().alias("found"), F.round("value", 4).alias("value"))


def nearest(obs: DataFrame, probes: DataFrame) -> DataFrame:
    """probe_id, stream_id, probe_ts, observed_ts, value, offset_seconds, exact_match_found; the earlier of two at the same distance.

    Probes and observations are one ordered stream: the last observation up to a probe and the first from it on are its neighbours. The work grows with
    both tables and not with their product.
    """
    there = obs.where("ts is not null and value is not null").join(probes.select("stream_id").distinct(), "stream_id", "left_semi")
    marks = there.select("stream_id", "ts", F.struct("ts", "value").alias("o"), F.lit(None).cast("bigint").alias("probe_id"))
    asked = probes.select("stream_id", F.col("probe_ts").alias("ts"), F.lit(None).cast(marks.schema["o"].dataType).alias("o"), F.col("probe_id").cast("bigint").alias("probe_id"))
    # Observations come before the probe of their instant, the larger value first, so that `last` takes the least one.
    order = Window.partitionBy("stream_id").orderBy("ts", F.col("probe_id").isNotNull(), F.col("o.value").desc())
    both = marks.unionByName(asked).select(
        "stream_id", "ts", "probe_id",
        F.last("o", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("left"),
        F.first("o", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing)).alias("right"),
    ).where("probe_id is not null")
    before, after = seconds_between("left.ts", "ts"), seconds_between("ts", "right.ts")
    chosen = F.when(F.col("right").isNull() | (before <= after), F.col("left")).otherwise(F.col("right"))
    out = both.select("probe_id", "stream_id", F.col("ts").alias("probe_ts"), chosen.alias("c")).where("c is not null")
    offset = F.abs(seconds_between("c.ts", "probe_ts"))
    return out.select("probe_id", "stream_id", "probe_ts", F.col("c.ts").alias("observed_ts"), F.round("c.value", 4).alias("value"), F.round(offset, 3).alias("offset_seconds"), (F.col("c.ts") == F.col("probe_ts")).alias("exact_match_found"))
