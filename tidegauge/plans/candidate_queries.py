"""Queries of the threshold and candidate layer."""

from __future__ import annotations


from pyspark.sql import functions as F

from tidegauge.operators import aggregates as A
from tidegauge.operators import candidates as C
from tidegauge.operators import selection as S
from tidegauge.operators import thresholds as T
from tidegauge.plans import views as V
from tidegauge.plans.registry import query
from tidegauge.tables import materialise


def points(spark, d):
    return A.with_ambiguity(V.inventory(spark, d))


def coarse(spark, d, period):
    """(points, aggregates, quality) of the coarse observations; the latter two are written, as several steps of a query read them."""
    obs = V.obs_coarse(spark, d)
    return points(spark, d), materialise(A.summarize(obs, period), period), materialise(A.quality(obs), "quality")


RATIO = "longest_gap_seconds / nullif(median_step_seconds, 0)"
USABLE = f"point_class <> 'Point' AND regexp_matches(point_class, '{C.VALID}') AND regexp_matches(point_class, '{C.COMPATIBLE}') AND NOT regexp_matches(point_class, '{{}}')"
AGG = USABLE.format(C.NO_AGGREGATION)

V.CTES["points"] = "SELECT *, count(*) OVER (PARTITION BY site_id, point_class, equipment_label, location_label) AS candidate_ambiguity FROM inventory"
V.CTES["week_metrics"] = V.quality_sql("(SELECT *, CAST(date_trunc('week', ts - INTERVAL 1 DAY) + INTERVAL 1 DAY AS TIMESTAMP) AS window_start FROM obs_coarse)", "site_id, stream_id, window_start")
for _p in ("day", "week", "month"):
    V.CTES[f"cover_{_p}"] = f"""SELECT a.*, least(1.0, count / greatest(1.0, floor(date_diff('microsecond', window_start, window_end) / 1e6 / median_step_seconds) + 1.0)) AS window_coverage
      FROM coarse_{_p} a JOIN coarse_quality USING (site_id, stream_id) WHERE median_step_seconds > 0"""
    V.CTES[f"caps_{_p}"] = f"""SELECT site_id, point_class, quantile_cont(abs(mean_value), 0.995) AS max_abs_mean FROM points JOIN coarse_{_p} USING (site_id, stream_id)
      WHERE {AGG} AND mean_value IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 100"""
    V.CTES[f"good_{_p}"] = f"""SELECT p.*, window_start, window_end, count, window_coverage, mean_value, max_abs_mean FROM points p JOIN cover_{_p} USING (site_id, stream_id)
      JOIN caps_{_p} USING (site_id, point_class) WHERE {AGG} AND window_coverage >= (SELECT quantile_cont(window_coverage, 0.10) FROM cover_{_p}) AND abs(mean_value) <= max_abs_mean"""

COLUMNS = "site_id, stream_id, point_class, equipment_label, location_label, window_start, window_end, count, window_coverage, mean_value, max_abs_mean, site_rank"


@query(
    "quality_thresholds",
    f"""SELECT round(quantile_cont(observed_fraction, 0.10), 4) AS abstain_observed_fraction_below, round(quantile_cont(observed_fraction, 0.75), 4) AS answer_observed_fraction_at_least,
    round(quantile_cont({RATIO}, 0.50), 4) AS answer_gap_ratio_at_most, round(quantile_cont({RATIO}, 0.95), 4) AS abstain_gap_ratio_above FROM fine_quality""",
)
def quality_thresholds(spark, d):
    return T.quality_reference(materialise(A.quality(V.obs_fine(spark, d)), "quality"))


@query("window_coverage", "SELECT * FROM cover_week")
def window_coverage(spark, d):
    _, weekly, quality = coarse(spark, d, "week")
    return T.window_coverage(weekly, quality)


WEEK_REFERENCE = f"""SELECT round(quantile_cont(observed_fraction, 0.10), 4) AS abstain_observed_fraction_below, round(quantile_cont(observed_fraction, 0.75), 4) AS answer_observed_fraction_at_least,
    round(quantile_cont(ratio, 0.50), 4) AS answer_gap_ratio_at_most, round(quantile_cont(ratio, 0.85), 4) AS abstain_gap_ratio_above FROM (
    SELECT *, least(count(observed_fraction) OVER w, count(ratio) OVER w) AS seen FROM (
      SELECT *, {RATIO} AS ratio, row_number() OVER (PARTITION BY site_id, stream_id ORDER BY window_start) AS k, row_number() OVER (PARTITION BY site_id ORDER BY stream_id, window_start) AS s FROM week_metrics)
    WHERE k <= 8 AND s <= 8000 WINDOW w AS (ORDER BY site_id, stream_id, window_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE seen < 2000"""
V.CTES["week_reference"] = WEEK_REFERENCE


@query("window_thresholds_week", "SELECT * FROM week_reference")
def window_thresholds_week(spark, d):
    return T.window_reference_week(T.week_quality(V.obs_coarse(spark, d)))


@query(
    "window_thresholds_day",
    f"""SELECT round(quantile_cont(window_coverage, 0.10), 4) AS abstain_observed_fraction_below, round(quantile_cont(window_coverage, 0.75), 4) AS answer_observed_fraction_at_least,
    (SELECT round(quantile_cont({RATIO}, 0.50), 4) FROM coarse_quality) AS answer_gap_ratio_at_most, (SELECT round(quantile_cont({RATIO}, 0.95), 4) FROM coarse_quality) AS abstain_gap_ratio_above FROM cover_day""",
)
def window_thresholds_day(spark, d):
    _, daily, quality = coarse(spark, d, "day")
    return T.window_reference_from_coverage(T.window_coverage(daily, quality), T.quality_reference(quality))


@query("class_counts_having", "SELECT site_id, point_class, count(*) AS class_size FROM points WHERE point_class <> 'Point' AND candidate_ambiguity = 1 GROUP BY 1, 2 HAVING count(*) >= 2")
def class_counts_having(spark, d):
    return points(spark, d).where(C.unambiguous()).groupBy("site_id", "point_class").agg(F.count("*").alias("class_size")).where("class_size >= 2")


@query("class_caps_p995", "SELECT site_id, point_class, round(max_abs_mean, 6) AS max_abs_mean FROM caps_week")
def class_caps_p995(spark, d):
    p, weekly, _ = coarse(spark, d, "week")
    return C.class_caps(p, weekly).withColumn("max_abs_mean", F.round("max_abs_mean", 6))


@query(
    "candidates_point_disambiguation",
    """SELECT * FROM (SELECT site_id, stream_id, point_class, equipment_label, location_label, class_size, row_number() OVER (PARTITION BY site_id ORDER BY class_size DESC, stream_id) AS site_rank
    FROM points JOIN (SELECT site_id, point_class, count(*) AS class_size FROM points WHERE point_class <> 'Point' AND candidate_ambiguity = 1 GROUP BY 1, 2 HAVING count(*) >= 2) USING (site_id, point_class)
    WHERE candidate_ambiguity = 1) WHERE site_rank <= 2000""",
)
def candidates_point_disambiguation(spark, d):
    return C.disambiguation(points(spark, d))


def rounded(df):
    return df.withColumn("max_abs_mean", F.round("max_abs_mean", 6))


def lookup_sql(period: str, own: str, order: str, cap: int | None = None) -> str:
    return f"""SELECT {COLUMNS.replace("max_abs_mean", "round(max_abs_mean, 6) AS max_abs_mean")} FROM (SELECT *, row_number() OVER (PARTITION BY {own} ORDER BY window_start {order}) AS own,
      row_number() OVER (PARTITION BY site_id ORDER BY stream_id, window_start {order}) AS site_rank FROM good_{period} WHERE candidate_ambiguity = 1) WHERE own = 1{f" AND site_rank <= {cap}" if cap else ""}"""


@query("candidates_window_mean", lookup_sql("week", "site_id, stream_id", ""))
def candidates_window_mean(spark, d):
    return rounded(C.mean_lookup(*coarse(spark, d, "week")))


@query("candidates_day_mean", lookup_sql("day", "site_id, stream_id, quarter(window_start)", ""))
def candidates_day_mean(spark, d):
    return rounded(C.quarter_lookup(*coarse(spark, d, "day")))


@query("candidates_relative_24h", lookup_sql("day", "site_id, stream_id, quarter(window_start)", "DESC"))
def candidates_relative_24h(spark, d):
    return rounded(C.quarter_lookup(*coarse(spark, d, "day"), latest=True))


V.CTES["good_pairs"] = """SELECT a.site_id, a.point_class, a.window_start, a.stream_id AS left_stream_id, a.equipment_label AS left_equipment_label, a.mean_value AS left_mean_value,
  b.stream_id AS right_stream_id, b.equipment_label AS right_equipment_label, b.mean_value AS right_mean_value, abs(a.mean_value - b.mean_value) AS diff_value
  FROM good_week a JOIN good_week b ON a.site_id = b.site_id AND a.point_class = b.point_class AND a.window_start = b.window_start AND a.stream_id < b.stream_id AND a.equipment_label <> b.equipment_label
  WHERE a.candidate_ambiguity = 1 AND b.candidate_ambiguity = 1"""


@query(
    "candidates_pairwise",
    """SELECT * REPLACE (round(min_gap, 6) AS min_gap) FROM (SELECT p.*, min_gap, row_number() OVER (PARTITION BY site_id ORDER BY diff_value DESC, point_class, window_start, left_stream_id, right_stream_id) AS site_rank
    FROM good_pairs p JOIN (SELECT site_id, point_class, quantile_cont(diff_value, 0.5) AS min_gap FROM good_pairs GROUP BY 1, 2) USING (site_id, point_class)
    WHERE diff_value > 0 AND diff_value >= min_gap) WHERE site_rank <= 2500""",
)
def candidates_pairwise(spark, d):
    return C.pairwise(*coarse(spark, d, "week")).withColumn("min_gap", F.round("min_gap", 6))


V.CTES["month_led"] = """SELECT a.site_id, a.location_type, a.point_class, a.window_start, a.window_end, a.n_streams, a.window_coverage, a.stream_id AS top_stream_id, a.mean_value AS top_mean_value,
  b.stream_id AS runner_stream_id, b.mean_value AS runner_mean_value, abs(a.mean_value - b.mean_value) AS margin_value
  FROM month_places a JOIN month_places b ON a.site_id = b.site_id AND a.location_type = b.location_type AND a.point_class = b.point_class AND a.window_start = b.window_start AND a.pos = 1 AND b.pos = 2"""
V.CTES["month_places"] = """SELECT g.*, n_streams, row_number() OVER (PARTITION BY g.site_id, g.location_type, g.point_class, g.window_start ORDER BY mean_value DESC, stream_id) AS pos FROM good_month g
  JOIN (SELECT site_id, location_type, point_class, window_start, window_end, count(DISTINCT stream_id) AS n_streams FROM good_month GROUP BY ALL HAVING count(DISTINCT stream_id) >= 3) USING (site_id, location_type, point_class, window_start, window_end)"""


@query(
    "candidates_window_rank",
    """SELECT * REPLACE (round(min_margin, 6) AS min_margin) FROM (SELECT f.*, min_margin, row_number() OVER (PARTITION BY site_id ORDER BY n_streams DESC, margin_value DESC, location_type, point_class, window_start, top_stream_id, runner_stream_id) AS site_rank
    FROM month_led f JOIN (SELECT site_id, location_type, point_class, quantile_cont(margin_value, 0.5) AS min_margin FROM month_led GROUP BY 1, 2, 3) USING (site_id, location_type, point_class)
    WHERE margin_value > 0 AND margin_value >= min_margin) WHERE site_rank <= 2000""",
)
def candidates_window_rank(spark, d):
    return C.window_rank(*coarse(spark, d, "month")).withColumn("min_margin", F.round("min_margin", 6))


def fine_points(spark, d):
    """Every stream of the fine observations as a point of its own."""
    streams = V.obs_fine(spark, d).select("site_id", "stream_id").distinct()
    named = streams.withColumns({"point_class": F.lit("Activity_Sensor"), "equipment_label": F.concat(F.lit("Unit "), "stream_id"), "location_label": F.lit(None).cast("string")})
    return A.with_ambiguity(named)


@query(
    "candidates_timestamp_value",
    """SELECT site_id, stream_id, point_class, requested_ts, observed_value FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY stream_id) AS c FROM (
      SELECT site_id, stream_id, 'Activity_Sensor' AS point_class, ts AS requested_ts, value AS observed_value, row_number() OVER (PARTITION BY site_id, stream_id ORDER BY ts, value) - 1 AS i,
      count(*) OVER (PARTITION BY site_id, stream_id) AS n FROM obs_fine JOIN fine_quality USING (site_id, stream_id) WHERE duplicate_timestamp_fraction = 0) WHERE n >= 3 AND i = n // 2) WHERE c <= 180""",
)
def candidates_timestamp_value(spark, d):
    obs = V.obs_fine(spark, d)
    return C.timestamp_value(fine_points(spark, d), A.quality(obs), obs)


@query(
    "candidates_timestamp_nearest",
    """SELECT site_id, stream_id, 'Activity_Sensor' AS point_class, observed_ts, observed_value, round(gap * 0.4, 3) AS offset_seconds FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY stream_id) AS c FROM (
      SELECT *, row_number() OVER (PARTITION BY site_id, stream_id ORDER BY ts, value) AS k FROM (
        SELECT o.*, median_step_seconds AS m, count(*) OVER (PARTITION BY site_id, stream_id) AS n, lag(ts) OVER w AS observed_ts, lag(value) OVER w AS observed_value, date_diff('microsecond', lag(ts) OVER w, ts) / 1e6 AS gap
        FROM obs_fine o JOIN fine_quality USING (site_id, stream_id) WHERE duplicate_timestamp_fraction = 0 AND median_step_seconds > 0 WINDOW w AS (PARTITION BY site_id, stream_id ORDER BY ts, value))
      WHERE n >= 3 AND gap > 0 AND gap >= greatest(1.0, 0.5 * m) AND gap <= 1.5 * m) WHERE k = 1) WHERE c <= 180""",
)
def candidates_timestamp_nearest(spark, d):
    obs = V.obs_fine(spark, d)
    return C.timestamp_nearest(fine_points(spark, d), A.quality(obs), obs)


V.CTES["gate"] = f"""SELECT * FROM (SELECT site_id, stream_id, point_class, window_start, observed_fraction, gap_ratio,
    CASE WHEN observed_fraction < abstain_observed_fraction_below OR gap_ratio > abstain_gap_ratio_above THEN 'abstain'
         WHEN observed_fraction >= answer_observed_fraction_at_least AND (gap_ratio IS NULL OR gap_ratio <= answer_gap_ratio_at_most) AND duplicate_timestamp_fraction = 0 AND nan_fraction = 0 THEN 'answer' END AS decision,
    CASE WHEN observed_fraction < abstain_observed_fraction_below THEN 'low_coverage' WHEN gap_ratio > abstain_gap_ratio_above THEN 'long_gap' ELSE 'healthy' END AS reason
    FROM (SELECT site_id, stream_id, point_class, window_start FROM points JOIN cover_week USING (site_id, stream_id) WHERE candidate_ambiguity = 1 AND {USABLE.format(C.NO_QUALITY)})
    JOIN (SELECT site_id, stream_id, window_start, n_points, observed_fraction, {RATIO} AS gap_ratio, duplicate_timestamp_fraction, nan_fraction FROM week_metrics) USING (site_id, stream_id, window_start), week_reference
    WHERE observed_fraction IS NOT NULL AND n_points >= 2) WHERE decision IS NOT NULL"""


@query(
    "candidates_quality_gate",
    """SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY turn, decision) AS place FROM (
    SELECT *, row_number() OVER (PARTITION BY site_id, decision ORDER BY point_class, stream_id, window_start) AS turn FROM gate)""",
)
def candidates_quality_gate(spark, d):
    p, weekly, quality = coarse(spark, d, "week")
    windows = materialise(T.week_quality(V.obs_coarse(spark, d)), "week-quality")
    return C.quality_gate(p, weekly, quality, windows, T.window_reference_week(windows))


@query(
    "take_by_split",
    f"""SELECT site_id, stream_id, point_class, split, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY site_rank, site_id) AS ordinal FROM (
      SELECT *, row_number() OVER (PARTITION BY split, site_id, point_class ORDER BY site_rank, site_id) AS k FROM (
        SELECT *, CASE WHEN site_id = 'EUROPE' THEN 'test' WHEN (sum(CASE WHEN site_id = 'EUROPE' THEN 0 ELSE 1 END) OVER (ORDER BY site_rank, site_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1) % 5 = 4 THEN 'dev' ELSE 'train' END AS split
        FROM ({lookup_sql("week", "site_id, stream_id", "", 3000)}))) WHERE k <= CASE split WHEN 'train' THEN 4 ELSE 2 END) WHERE ordinal <= CASE split WHEN 'train' THEN 40 ELSE 10 END""",
)
def take_by_split(spark, d):
    rows = C.mean_lookup(*coarse(spark, d, "week"), per_site=3000)
    out = S.take_by_split(rows, ["site_rank", "site_id"], "site_id = 'EUROPE'", ["site_id", "point_class"], {"train": 40, "dev": 10, "test": 10}, {"train": 4, "dev": 2, "test": 2})
    return out.select("site_id", "stream_id", "point_class", "split", F.col("ordinal"))
