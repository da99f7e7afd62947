"""Window statistics of a stream of observations, kept up to date batch by batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.columns import exact_mean, is_finite

WIDTHS = {"day": ("1 day", "1 day", "0 days"), "week": ("7 days", "7 days", "5 days")}


def zoneless(instant: str) -> Column:
    """An instant of whole seconds as a zoneless time in UTC."""
    seconds = F.unix_seconds(F.col(instant))
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.floor(seconds / 86400).cast("int"), F.lit(0), F.lit(0), (seconds % 86400).cast("decimal(18,6)"))


def windowed(stream: DataFrame, period: str = "day", late: str = "2 days") -> DataFrame:
    """Statistics per stream and day, or week from Tuesday on; what comes later than `late` is dropped. Works on batches too.

    Ends of windows are those of the calendar: that of the stored aggregates needs the stream's next window, which a stream doesn't know yet.
    """
    # Watermarks take instants only: zoneless times are seen as UTC, whatever the session's zone, and turned back below.
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    timed = stream.withColumn("instant", F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, F.col("ts"))))
    marked = timed.withWatermark("instant", late) if stream.isStreaming else timed
    rows = marked.where(is_finite("value")).groupBy("site_id", "stream_id", F.window("instant", *WIDTHS[period]).alias("w"))
    stats = rows.agg(F.count("*").alias("count"), exact_mean("value").alias("mean_value"), F.min("value").alias("min_value"), F.max("value").alias("max_value"))
    return stats.select("site_id", "stream_id", zoneless("w.start").alias("window_start"), zoneless("w.end").alias("window_end"), "count", "mean_value", "min_value", "max_value")


def run_available(spark: SparkSession, stream: DataFrame, path: str, period: str = "day", late: str = "2 days") -> DataFrame:
    """Process what the source holds now and return the statistics, written under path with the checkpoint that a later run goes on from.

    Each batch writes the windows that it changed, under its own number, so that one that is run again replaces itself; a window's last batch counts. Windows that the
    watermark has passed leave the state.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/table/batch={number}")

    query = windowed(stream, period, late).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return latest(spark.read.parquet(f"{path}/table"))


def latest(updates: DataFrame) -> DataFrame:
    """Each window as the last batch that changed it left it."""
    keys = ["site_id", "stream_id", "window_start", "window_end"]
    rest = [c for c in updates.columns if c not in (*keys, "batch")]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_s")).select(*keys, "_s.*")
