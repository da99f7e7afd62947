"""Queries of the store layer: aggregates, profiles, quality, inventory."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidegauge.functions.columns import day_of, exact_mean
from tidegauge.operators import aggregates as A
from tidegauge.operators import lineage
from tidegauge.plans import views as V
from tidegauge.plans.registry import query
from tidegauge.sources import zips
from tidegauge.tables import shared_folder


@query("daily_aggregates", "SELECT * FROM fine_day")
def daily_aggregates(spark, d):
    return A.summarize(V.obs_fine(spark, d), "day")


@query("weekly_aggregates_tue", "SELECT * FROM coarse_week")
def weekly_aggregates_tue(spark, d):
    return A.summarize(V.obs_coarse(spark, d), "week")


@query("monthly_aggregates", "SELECT * FROM coarse_month")
def monthly_aggregates(spark, d):
    return A.summarize(V.obs_coarse(spark, d), "month")


@query(
    "calendar_profile",
    """SELECT site_id, stream_id, isodow(ts) - 1 AS day_of_week, hour(ts) AS hour_of_day, count(*) AS count,
       CAST(sum(CAST(value AS DECIMAL(20, 6))) AS DOUBLE) / count(*) AS mean_value, round(stddev_samp(value), 4) AS std_value, min(value) AS min_value, max(value) AS max_value
       FROM obs_fine WHERE isfinite(value) GROUP BY 1, 2, 3, 4""",
)
def calendar_profile(spark, d):
    return A.calendar_profile(V.obs_fine(spark, d))


@query("hourly_resample", "SELECT site_id, stream_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, CAST(sum(CAST(value AS DECIMAL(20, 6))) AS DOUBLE) / count(*) AS mean_value, count(*) AS count FROM obs_fine GROUP BY 1, 2, 3")
def hourly_resample(spark, d):
    return A.hourly_mean(V.obs_fine(spark, d))


@query("quality_metrics", "SELECT * FROM fine_quality")
def quality_metrics(spark, d):
    return A.quality(V.obs_fine(spark, d))


@query("quality_metrics_coarse", "SELECT * FROM coarse_quality")
def quality_metrics_coarse(spark, d):
    return A.quality(V.obs_coarse(spark, d))


@query(
    "inventory_summary",
    """SELECT i.*, n_points, n_distinct, first_ts, last_ts, mean_value, std_value, min_value, max_value FROM inventory i JOIN (
       SELECT site_id, stream_id, count(value) AS n_points, count(DISTINCT value) AS n_distinct, min(ts) AS first_ts, max(ts) AS last_ts,
       CAST(sum(CAST(value AS DECIMAL(20, 6))) AS DOUBLE) / count(value) AS mean_value, coalesce(round(stddev_samp(value), 4), 0.0) AS std_value, min(value) AS min_value, max(value) AS max_value
       FROM obs_coarse GROUP BY 1, 2) USING (site_id, stream_id)""",
)
def inventory_summary(spark, d):
    return A.inventory_summary(V.inventory(spark, d), V.obs_coarse(spark, d))


@query(
    "candidate_ambiguity",
    """SELECT *, count(stream_id) OVER (PARTITION BY candidate_key) AS candidate_ambiguity FROM (SELECT *,
       trim(regexp_replace(lower(site_id), '[^\\p{L}\\p{N}]+', ' ', 'g')) || '|' || trim(regexp_replace(lower(point_class), '[^\\p{L}\\p{N}]+', ' ', 'g')) || '|' ||
       trim(regexp_replace(lower(equipment_label), '[^\\p{L}\\p{N}]+', ' ', 'g')) || '|' || trim(regexp_replace(lower(location_label), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS candidate_key FROM inventory)""",
)
def candidate_ambiguity(spark, d):
    return A.with_ambiguity(V.inventory(spark, d))


@query(
    "stream_preview",
    """SELECT site_id, stream_id, i, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY site_id, stream_id ORDER BY ts, value) - 1 AS i,
       count(*) OVER (PARTITION BY site_id, stream_id) AS n FROM obs_fine) WHERE n <= 48 OR i = n - 1 OR list_contains(list_transform(range(47), lambda k: CAST(floor(k * ((n - 1) / 47.0::DOUBLE)) AS BIGINT)), i)""",
)
def stream_preview(spark, d):
    return A.previews(V.obs_fine(spark, d), 48)


@query(
    "raw_index_dedup",
    """SELECT i.stream_id, i.site_id, i.point_class, r.member_name, r.n_points, r.member_name IS NOT NULL AS has_raw FROM inventory i LEFT JOIN (
       SELECT * FROM (SELECT 'sup_' || l_suppkey AS stream_id, l_returnflag || '/' || l_linestatus AS member_name, count(*) AS n_points,
       row_number() OVER (PARTITION BY l_suppkey ORDER BY l_returnflag || '/' || l_linestatus) AS k FROM lineitem WHERE l_suppkey % 7 <> 0 GROUP BY l_suppkey, l_returnflag, l_linestatus) WHERE k = 1) r USING (stream_id)""",
)
def raw_index_dedup(spark, d):
    """A stream may stand in several archive members; the first by name is its lineage."""
    members = V.table(spark, d, "lineitem").where("l_suppkey % 7 <> 0").groupBy(F.concat(F.lit("sup_"), F.col("l_suppkey").cast("string")).alias("stream_id"), F.concat("l_returnflag", F.lit("/"), "l_linestatus").alias("member_name")).agg(F.count("*").alias("n_points"))
    return lineage.with_lineage(V.inventory(spark, d).select("stream_id", "site_id", "point_class"), members)


@query("unpivot_wide", "SELECT reading_id, ts, measure, value FROM (SELECT l_orderkey || '_' || l_linenumber || '_' || l_partkey AS reading_id, l_shipdate AS ts, l_quantity, l_discount, l_tax FROM lineitem) UNPIVOT (value FOR measure IN (l_quantity, l_discount, l_tax))")
def unpivot_wide(spark, d):
    return V.wide(spark, d).unpivot(["reading_id", "ts"], ["l_quantity", "l_discount", "l_tax"], "measure", "value")


@query("daily_mean_by_class", "SELECT point_class, CAST(date_trunc('month', ts) AS TIMESTAMP) AS month, count(*) AS n, count(DISTINCT stream_id) AS streams FROM obs_coarse JOIN inventory USING (site_id, stream_id) GROUP BY 1, 2")
def daily_mean_by_class(spark, d):
    from tidegauge.functions.columns import month_of

    joined = V.obs_coarse(spark, d).join(V.inventory(spark, d), ["site_id", "stream_id"])
    return joined.groupBy("point_class", month_of("ts").alias("month")).agg(F.count("*").alias("n"), F.countDistinct("stream_id").alias("streams"))


@query(
    "archive_index",
    "SELECT stream_id, count(*) AS n_points, min(ts) AS first_ts, max(ts) AS last_ts, round(sum(value), 2) AS total FROM obs_fine GROUP BY 1",
)
def archive_index(spark, d):
    """All fine observations written as archives of a member for each stream, and read back by members."""
    folder = f"{shared_folder(spark)}/archives-{uuid.uuid4().hex}"
    zips.write_archives(V.obs_fine(spark, d), folder.removeprefix("file://"), 8)
    rows = zips.load_streams(spark, folder.removeprefix("file://")).where("error_type is null")
    return rows.groupBy("stream_id").agg(F.count("*").alias("n_points"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.round(F.sum("value"), 2).alias("total"))
