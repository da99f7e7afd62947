"""The star-schema tables seen as telemetry: observations, inventory, graph; for Spark, and as common table expressions for the SQL of tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLASSES = ["Air_Temperature_Sensor", "Zone_Temperature_Setpoint", "Air_Flow_Sensor", "Max_Flow_Limit", "Point"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per supplier: a stream with its class, equipment and location."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    kind = F.element_at(F.array(*map(F.lit, CLASSES)), (F.col("s_suppkey") % 5 + 1).cast("int"))
    return joined.select(
        F.col("r_name").alias("site_id"),
        F.concat(F.lit("sup_"), F.col("s_suppkey").cast("string")).alias("stream_id"),
        kind.alias("point_class"),
        F.col("s_name").alias("point_label"),
        F.when(F.col("s_suppkey") % 2 == 0, "AHU").otherwise("FCU").alias("equipment_type"),
        F.concat("r_name", F.lit(" Unit "), F.lpad((F.col("s_suppkey") % 20).cast("string"), 3, "0")).alias("equipment_label"),
        F.lit("Nation").alias("location_type"),
        F.col("n_name").alias("location_label"),
    )


def obs_fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("SITE_"), (F.col("user_id") % 3).cast("string")).alias("site_id"), F.concat(F.lit("usr_"), F.col("user_id").cast("string")).alias("stream_id"), "ts", "value")


def obs_coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("sup_"), F.col("l_suppkey").cast("string")).alias("stream_id"), F.col("l_shipdate").alias("ts"), F.col("l_extendedprice").alias("value"))
    return facts.join(inventory(spark, sf_dir).select("site_id", "stream_id"), "stream_id").select("site_id", "stream_id", "ts", "value")


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.concat_ws("_", "l_orderkey", "l_linenumber", "l_partkey").alias("reading_id"), F.col("l_shipdate").alias("ts"), "l_quantity", "l_discount", "l_tax")


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(entities, relations): suppliers point at nations, nations at regions."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))

    def node(df: DataFrame, prefix: str, key: str, label: str, *types: str) -> DataFrame:
        return df.select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("entity_id"), F.col(label).alias("entity_label"), F.array(*map(F.lit, types)).alias("types"))

    entities = node(s, "sup_", "s_suppkey", "s_name", "Point", "Supplier_Sensor").unionByName(node(n, "nat_", "n_nationkey", "n_name", "Entity", "Nation")).unionByName(node(r, "reg_", "r_regionkey", "r_name", "Entity", "Region"))

    def edge(df: DataFrame, a: str, ka: str, predicate: str, b: str, kb: str) -> DataFrame:
        return df.select(F.concat(F.lit(a), F.col(ka).cast("string")).alias("source_entity"), F.lit(predicate).alias("predicate"), F.concat(F.lit(b), F.col(kb).cast("string")).alias("target_entity"))

    relations = edge(s, "sup_", "s_suppkey", "isPointOf", "nat_", "s_nationkey").unionByName(edge(n, "nat_", "n_nationkey", "hasLocation", "reg_", "n_regionkey"))
    return entities, relations


# ---- the same in SQL

CTES: dict[str, str] = {
    "inventory": """SELECT r_name AS site_id, 'sup_' || s_suppkey AS stream_id,
  CASE s_suppkey % 5 WHEN 0 THEN 'Air_Temperature_Sensor' WHEN 1 THEN 'Zone_Temperature_Setpoint' WHEN 2 THEN 'Air_Flow_Sensor' WHEN 3 THEN 'Max_Flow_Limit' ELSE 'Point' END AS point_class,
  s_name AS point_label, CASE WHEN s_suppkey % 2 = 0 THEN 'AHU' ELSE 'FCU' END AS equipment_type,
  r_name || ' Unit ' || lpad(CAST(s_suppkey % 20 AS VARCHAR), 3, '0') AS equipment_label, 'Nation' AS location_type, n_name AS location_label
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "obs_fine": "SELECT 'SITE_' || (user_id % 3) AS site_id, 'usr_' || user_id AS stream_id, ts, value FROM events",
    "obs_coarse": "SELECT i.site_id, i.stream_id, l_shipdate AS ts, l_extendedprice AS value FROM lineitem JOIN inventory i ON i.stream_id = 'sup_' || l_suppkey",
}


def aggregate_sql(obs: str, period: str) -> str:
    bucket = {"day": "date_trunc('day', ts)", "week": "date_trunc('week', ts - INTERVAL 1 DAY) + INTERVAL 1 DAY", "month": "date_trunc('month', ts)"}[period]
    days = {"day": 1, "week": 7, "month": 31}[period]
    return f"""SELECT site_id, stream_id, '{period}' AS period, ws AS window_start,
  coalesce(lead(ws) OVER (PARTITION BY site_id, stream_id ORDER BY ws), ws + INTERVAL {days} DAY) AS window_end,
  count, mean_value, std_value, min_value, max_value
  FROM (SELECT site_id, stream_id, CAST({bucket} AS TIMESTAMP) AS ws, count(*) AS count,
        CAST(sum(CAST(value AS DECIMAL(20, 6))) AS DOUBLE) / count(*) AS mean_value, round(stddev_samp(value), 4) AS std_value, min(value) AS min_value, max(value) AS max_value
        FROM {obs} WHERE isfinite(value) GROUP BY 1, 2, 3)"""


def quality_sql(obs: str, keys: str = "site_id, stream_id") -> str:
    return f"""SELECT {keys}, n_points, first_ts, last_ts, median_step_seconds, longest_gap_seconds,
  CASE WHEN raw_step IS NOT NULL THEN round(least(1.0, n_points / (round_even(date_diff('microsecond', first_ts, last_ts) / 1e6 / raw_step, 0) + 1)), 6) END AS observed_fraction,
  nan_fraction, zero_fraction, constant_fraction, duplicate_timestamp_fraction
  FROM (SELECT {keys}, count(*) AS n_points, min(ts) AS first_ts, max(ts) AS last_ts,
    quantile_cont(gap, 0.5) FILTER (gap > 0) AS raw_step, round(quantile_cont(gap, 0.5) FILTER (gap > 0), 7) AS median_step_seconds, max(gap) AS longest_gap_seconds,
    round(1 - count(*) FILTER (isfinite(value)) / count(*), 6) AS nan_fraction,
    round(count(*) FILTER (isfinite(value) AND value = 0) / nullif(count(*) FILTER (isfinite(value)), 0), 6) AS zero_fraction,
    round(count(*) FILTER (isfinite(value) AND value = before) / nullif(count(*) FILTER (isfinite(value)) - 1, 0), 6) AS constant_fraction,
    round(1 - count(DISTINCT ts) / count(*), 6) AS duplicate_timestamp_fraction
    FROM (SELECT *, date_diff('microsecond', lag(ts) OVER (PARTITION BY {keys} ORDER BY ts, value), ts) / 1e6 AS gap,
          lag(value) OVER (PARTITION BY {keys} ORDER BY ts, value) AS before FROM {obs})
    GROUP BY {keys})"""


for _obs, _short in (("obs_fine", "fine"), ("obs_coarse", "coarse")):
    for _p in ("day", "week", "month"):
        CTES[f"{_short}_{_p}"] = aggregate_sql(_obs, _p)
    CTES[f"{_short}_quality"] = quality_sql(_obs)


def with_ctes(body: str, extra: dict[str, str] | None = None) -> str:
    """The body behind the common table expressions that it names, directly or through others."""
    import re

    known, order = CTES | (extra or {}), []

    def need(text: str) -> None:
        for name in known:
            if name not in order and re.search(rf"\b{name}\b", text):
                need(known[name].replace(f" {name} ", " "))
                if name not in order:
                    order.append(name)

    need(body)
    return "WITH " + ",\n".join(f"{n} AS ({known[n]})" for n in order) + "\n" + body if order else body
