"""Queries of the tool and decision layer."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidegauge.functions import columns as K
from tidegauge.functions import decisions as D
from tidegauge.operators import aggregates as A
from tidegauge.operators import asof
from tidegauge.operators import thresholds as T
from tidegauge.operators import tools
from tidegauge.plans import views as V
from tidegauge.plans.candidate_queries import RATIO
from tidegauge.plans.registry import query
from tidegauge.tables import materialise


def flat(df):
    """Lists of ids as text."""
    return df.withColumn("stream_ids", F.concat_ws(",", "stream_ids"))


@query(
    "resolve_point_exact",
    """SELECT r.stream_id AS request_id, count(*) AS match_count, string_agg(i.stream_id, ',' ORDER BY i.stream_id) AS stream_ids, CASE WHEN count(*) = 1 THEN min(i.stream_id) END AS stream_id, CAST(NULL AS VARCHAR) AS resolution_strategy
    FROM inventory r JOIN inventory i ON r.site_id = i.site_id AND r.point_class = i.point_class AND r.equipment_label = i.equipment_label AND r.location_label = i.location_label GROUP BY 1""",
)
def resolve_point_exact(spark, d):
    inv = V.inventory(spark, d)
    requests = inv.select(F.col("stream_id").alias("request_id"), "site_id", "point_class", F.upper("equipment_label").alias("equipment_label"), "location_label")
    return flat(tools.resolve_points(inv, requests, aliases(spark)))


def aliases(spark):
    return spark.createDataFrame([("Temp", "Air_Temperature_Sensor"), ("Temp", "Zone_Temperature_Setpoint"), ("Flow", "Air_Flow_Sensor")], "alias string, point_class string")


@query(
    "resolve_point_fallback",
    """SELECT r.request_id, count(i.stream_id) AS match_count, coalesce(string_agg(i.stream_id, ',' ORDER BY i.stream_id), '') AS stream_ids, CASE WHEN count(i.stream_id) = 1 THEN min(i.stream_id) END AS stream_id,
    CASE WHEN count(i.stream_id) > 0 THEN 'fallback' END AS resolution_strategy
    FROM (SELECT stream_id AS request_id, site_id, CASE WHEN contains(point_class, 'Temperature') THEN 'Temp' WHEN contains(point_class, 'Flow_Sensor') THEN 'Flow' ELSE 'Unknown' END AS asked, equipment_label FROM inventory) r
    LEFT JOIN inventory i ON r.site_id = i.site_id AND r.equipment_label = i.equipment_label AND ((asked = 'Temp' AND contains(i.point_class, 'Temperature')) OR (asked = 'Flow' AND i.point_class = 'Air_Flow_Sensor')) GROUP BY 1""",
)
def resolve_point_fallback(spark, d):
    inv = V.inventory(spark, d)
    asked = F.when(F.contains("point_class", F.lit("Temperature")), "Temp").when(F.contains("point_class", F.lit("Flow_Sensor")), "Flow").otherwise("Unknown")
    messy = F.concat(F.lit("`"), F.upper("equipment_label"), F.lit("`  "))
    requests = inv.select(F.col("stream_id").alias("request_id"), "site_id", asked.alias("point_class"), messy.alias("equipment_label"), F.lit(None).cast("string").alias("location_label"))
    return flat(tools.resolve_points(inv, requests, aliases(spark)))


@query(
    "list_points",
    """SELECT r.request_id, count(i.stream_id) AS count, coalesce(string_agg(i.stream_id, ',' ORDER BY i.stream_id), '') AS stream_ids
    FROM (SELECT DISTINCT site_id || '/' || point_class AS request_id, site_id, point_class FROM inventory UNION ALL SELECT DISTINCT site_id || '/*', site_id, NULL FROM inventory) r
    LEFT JOIN inventory i ON r.site_id = i.site_id AND (r.point_class IS NULL OR r.point_class = i.point_class) AND i.equipment_type = 'AHU' GROUP BY 1""",
)
def list_points(spark, d):
    inv = V.inventory(spark, d)
    by_class = inv.select(F.concat("site_id", F.lit("/"), "point_class").alias("request_id"), "site_id", "point_class").distinct()
    whole = inv.select(F.concat("site_id", F.lit("/*")).alias("request_id"), "site_id", F.lit(None).cast("string").alias("point_class")).distinct()
    requests = by_class.unionByName(whole).withColumns({"equipment_type": F.lit("AHU"), "location_type": F.lit(None).cast("string")})
    return flat(tools.list_points(inv, requests))


def window_requests(weekly, shift_days=0):
    """A request for each stored week, moved by some days."""
    move = F.make_dt_interval(F.lit(shift_days))
    return weekly.select(F.concat_ws("@", "stream_id", F.date_format("window_start", "yyyyMMdd")).alias("request_id"), "stream_id", F.lit("week").alias("period"), (F.col("window_start") + move).alias("window_start"), (F.col("window_end") + move).alias("window_end"))


REQUEST = "stream_id || '@' || strftime(window_start, '%Y%m%d')"
RAW = f"""SELECT r.request_id, r.stream_id, r.window_start, r.window_end, 'observations' AS source, CAST(sum(CAST(value AS DECIMAL(20, 6))) AS DOUBLE) / nullif(count(value), 0) AS mean_value,
  round(stddev_pop(value), 4) AS std_value, min(value) AS min_value, max(value) AS max_value, count(value) AS count
  FROM (SELECT {REQUEST} AS request_id, stream_id, window_start + INTERVAL 3 DAY AS window_start, window_end + INTERVAL 3 DAY AS window_end FROM fine_week) r
  LEFT JOIN obs_fine o ON o.stream_id = r.stream_id AND o.ts >= r.window_start AND o.ts < r.window_end GROUP BY ALL"""
V.CTES["shifted_results"] = RAW


@query("aggregate_window_precomputed", f"SELECT {REQUEST} AS request_id, stream_id, window_start, window_end, 'stored' AS source, mean_value, std_value, min_value, max_value, count FROM fine_week")
def aggregate_window_precomputed(spark, d):
    obs = V.obs_fine(spark, d)
    weekly = A.summarize(obs, "week")
    return tools.aggregate_window(obs, weekly, window_requests(weekly), digits=None)


def shifted_results(spark, d):
    obs = V.obs_fine(spark, d)
    weekly = A.summarize(obs, "week")
    return tools.aggregate_window(obs, weekly, window_requests(weekly, 3), digits=None)


@query("aggregate_window_adhoc", "SELECT * FROM shifted_results")
def aggregate_window_adhoc(spark, d):
    return shifted_results(spark, d)


@query(
    "compare_window",
    """SELECT request_id, lag_value AS left_value, mean_value AS right_value, CASE WHEN lag_value IS NULL OR mean_value IS NULL THEN NULL WHEN lag_value > mean_value THEN lag_stream ELSE stream_id END AS winner
    FROM (SELECT request_id, stream_id, mean_value, lag(mean_value) OVER w AS lag_value, lag(stream_id) OVER w AS lag_stream, lag(request_id) OVER w AS other FROM shifted_results WINDOW w AS (PARTITION BY window_start ORDER BY request_id)) WHERE other IS NOT NULL""",
)
def compare_window(spark, d):
    """Neighbours among the requests of one week."""
    results = shifted_results(spark, d)
    pairs = results.select("request_id", F.lag("request_id").over(Window.partitionBy("window_start").orderBy("request_id")).alias("left_request"), F.col("request_id").alias("right_request")).where("left_request is not null")
    return tools.compare_window(results, pairs)


@query(
    "rank_window_topk",
    """SELECT * FROM (SELECT window_start, row_number() OVER (PARTITION BY window_start ORDER BY mean_value DESC, stream_id DESC) AS place, stream_id, mean_value AS value FROM shifted_results WHERE mean_value IS NOT NULL) WHERE place <= 3""",
)
def rank_window_topk(spark, d):
    return tools.rank_window(shifted_results(spark, d), ["window_start"], topk=3)


def probes(spark, d):
    """Every event: those of even number moved by half an hour, the others as they are."""
    e = V.table(spark, d, "events")
    return e.select(F.col("event_id").alias("probe_id"), F.concat(F.lit("usr_"), F.col("user_id").cast("string")).alias("stream_id"), (F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.when(F.col("event_id") % 2 == 0, 30).otherwise(0))).alias("probe_ts"))


V.CTES["probes"] = "SELECT event_id AS probe_id, 'usr_' || user_id AS stream_id, CASE WHEN event_id % 2 = 0 THEN ts + INTERVAL 30 MINUTE ELSE ts END AS probe_ts FROM events"
V.CTES["nearest_rows"] = """SELECT probe_id, stream_id, probe_ts, ts AS observed_ts, round(value, 4) AS value, round(gap, 3) AS offset_seconds, ts = probe_ts AS exact_match_found FROM (
  SELECT p.*, o.ts, o.value, abs(date_diff('microsecond', o.ts, probe_ts)) / 1e6 AS gap, row_number() OVER (PARTITION BY probe_id ORDER BY abs(date_diff('microsecond', o.ts, probe_ts)), o.ts, o.value) AS k
  FROM probes p JOIN obs_fine o USING (stream_id)) WHERE k = 1"""


@query("lookup_exact", "SELECT probe_id, p.stream_id, probe_ts, count(o.ts) > 0 AS found, round(min(value), 4) AS value FROM probes p LEFT JOIN obs_fine o ON p.stream_id = o.stream_id AND o.ts = probe_ts GROUP BY ALL")
def lookup_exact(spark, d):
    return asof.exact(V.obs_fine(spark, d), probes(spark, d))


@query("lookup_nearest", "SELECT * FROM nearest_rows")
def lookup_nearest(spark, d):
    return asof.nearest(V.obs_fine(spark, d), probes(spark, d))


V.CTES["fine_reference"] = f"""SELECT round(quantile_cont(observed_fraction, 0.10), 4) AS abstain_observed_fraction_below, round(quantile_cont(observed_fraction, 0.75), 4) AS answer_observed_fraction_at_least,
  round(quantile_cont({RATIO}, 0.50), 4) AS answer_gap_ratio_at_most, round(quantile_cont({RATIO}, 0.95), 4) AS abstain_gap_ratio_above FROM fine_quality"""


@query("inspect_quality", f"SELECT q.*, round({RATIO}, 4) AS gap_ratio, r.* FROM fine_quality q, fine_reference r")
def inspect_quality(spark, d):
    q = A.quality(V.obs_fine(spark, d))
    return tools.inspect_quality(q, T.quality_reference(q), q.select("stream_id"))


V.CTES["window_metrics"] = V.quality_sql(f"(SELECT o.*, request_id FROM (SELECT {REQUEST} AS request_id, stream_id, window_start + INTERVAL 3 DAY AS a, window_end + INTERVAL 3 DAY AS b FROM fine_week) r JOIN obs_fine o ON o.stream_id = r.stream_id AND ts >= a AND ts < b)", "request_id")


@query(
    "inspect_quality_window",
    f"""SELECT r.request_id, r.stream_id, m.* EXCLUDE (request_id), round({RATIO}, 4) AS gap_ratio, f.* FROM (SELECT {REQUEST} AS request_id, stream_id FROM fine_week) r LEFT JOIN window_metrics m USING (request_id), fine_reference f""",
)
def inspect_quality_window(spark, d):
    obs = V.obs_fine(spark, d)
    return tools.inspect_quality_window(obs, window_requests(A.summarize(obs, "week"), 3), T.quality_reference(A.quality(obs)))


@query(
    "describe_fallback",
    """SELECT s.stream_id, coalesce(r.site_id, i.site_id) AS site_id, coalesce(r.point_class, i.point_class) AS point_class, CASE WHEN r.stream_id IS NOT NULL THEN 'ready' WHEN i.stream_id IS NOT NULL THEN 'inventory' ELSE 'id' END AS source
    FROM (SELECT stream_id FROM inventory UNION ALL SELECT 'sup_x' || n_nationkey FROM nation) s LEFT JOIN (SELECT * FROM inventory WHERE point_class <> 'Point') r ON r.stream_id = s.stream_id LEFT JOIN inventory i ON i.stream_id = s.stream_id""",
)
def describe_fallback(spark, d):
    inv = V.inventory(spark, d)
    asked = inv.select("stream_id").unionByName(V.table(spark, d, "nation").select(F.concat(F.lit("sup_x"), F.col("n_nationkey").cast("string")).alias("stream_id")))
    return tools.describe(asked, inv.where("point_class <> 'Point'"), inv, ["site_id", "point_class"])


# ---- decisions

V.CTES["judged"] = f"""SELECT *, CASE WHEN low OR far THEN 'abstain' WHEN good THEN 'answer' ELSE 'abstain' END AS action, CASE WHEN low THEN 'low_coverage' WHEN far THEN 'long_gap' WHEN good THEN 'healthy' ELSE 'marginal_quality' END AS reason
  FROM (SELECT site_id, stream_id, window_start, observed_fraction, gap_ratio, coalesce(observed_fraction < abstain_observed_fraction_below, false) AS low, coalesce(gap_ratio > abstain_gap_ratio_above, false) AS far,
        coalesce(observed_fraction >= answer_observed_fraction_at_least AND (gap_ratio IS NULL OR gap_ratio <= answer_gap_ratio_at_most), false) AS good
        FROM (SELECT *, {RATIO} AS gap_ratio FROM week_metrics), week_reference)"""


def judged(spark, d):
    # Written, as the thresholds and the decisions both read it.
    windows = materialise(T.week_quality(V.obs_coarse(spark, d)), "week-quality")
    rows = windows.withColumn("gap_ratio", T.gap_ratio()).crossJoin(F.broadcast(T.window_reference_week(windows)))
    return rows.select("site_id", "stream_id", "window_start", "observed_fraction", "gap_ratio", D.quality_decision().alias("d")).select("site_id", "stream_id", "window_start", "observed_fraction", "gap_ratio", "d.action", "d.reason")


@query("quality_decision", "SELECT site_id, stream_id, window_start, observed_fraction, gap_ratio, action, reason FROM judged")
def quality_decision(spark, d):
    return judged(spark, d)


V.CTES["successive"] = """SELECT site_id, stream_id, window_start, action AS a1, reason AS r1, observed_fraction AS o1, gap_ratio AS g1, lead(action) OVER w AS a2, lead(reason) OVER w AS r2, lead(observed_fraction) OVER w AS o2, lead(gap_ratio) OVER w AS g2
  FROM judged WINDOW w AS (PARTITION BY stream_id ORDER BY window_start)"""


def successive(spark, d):
    w = Window.partitionBy("stream_id").orderBy("window_start")
    rows = judged(spark, d).select("site_id", "stream_id", "window_start", *[x.alias(f"{n}{k}") for n, c in (("a", "action"), ("r", "reason"), ("o", "observed_fraction"), ("g", "gap_ratio")) for k, x in ((1, F.col(c)), (2, F.lead(c).over(w)))])
    return rows.where("a2 is not null")


@query(
    "quality_preference",
    """SELECT site_id, stream_id, window_start, CASE WHEN (a1 = 'answer')::INT > (a2 = 'answer')::INT THEN 'first' WHEN (a1 = 'answer')::INT < (a2 = 'answer')::INT THEN 'second'
    WHEN (p1 >= 0.95)::INT > (p2 >= 0.95)::INT THEN 'first' WHEN (p1 >= 0.95)::INT < (p2 >= 0.95)::INT THEN 'second' WHEN b1 > b2 THEN 'first' WHEN b1 < b2 THEN 'second'
    WHEN n1 > n2 THEN 'first' WHEN n1 < n2 THEN 'second' WHEN p1 > p2 THEN 'first' WHEN p1 < p2 THEN 'second' WHEN (r1 = 'healthy')::INT >= (r2 = 'healthy')::INT THEN 'first' ELSE 'second' END AS preferred_reference
    FROM (SELECT *, coalesce(-g1, '-inf'::DOUBLE) AS n1, coalesce(-g2, '-inf'::DOUBLE) AS n2, round_even(p1, 2) AS b1, round_even(p2, 2) AS b2 FROM (SELECT *, CASE WHEN coalesce(o1, 0) = 0 THEN -1.0 ELSE o1 END AS p1, CASE WHEN coalesce(o2, 0) = 0 THEN -1.0 ELSE o2 END AS p2 FROM successive WHERE a2 IS NOT NULL))""",
)
def quality_preference(spark, d):
    c = F.col
    first, second = D.preference_rank(c("a1"), c("r1"), c("o1"), c("g1")), D.preference_rank(c("a2"), c("r2"), c("o2"), c("g2"))
    return successive(spark, d).select("site_id", "stream_id", "window_start", D.preferred(first, second).alias("preferred_reference"))


@query(
    "quality_trend",
    """SELECT site_id, stream_id, window_start, CASE WHEN o1 IS NOT NULL AND g1 IS NOT NULL AND (o2 IS NULL OR g2 IS NULL) THEN 'quality_worsened' WHEN o2 IS NOT NULL AND g2 IS NOT NULL AND (o1 IS NULL OR g1 IS NULL) THEN 'quality_improved'
    WHEN a1 = 'abstain' AND a2 = 'answer' THEN 'quality_improved' WHEN a1 = 'answer' AND a2 = 'abstain' THEN 'quality_worsened'
    WHEN (od >= 0.02 AND gd >= -1.0) OR (gd >= 0.5 AND od >= -0.05) THEN 'quality_improved' WHEN (od <= -0.02 AND gd <= 1.0) OR (gd <= -0.5 AND od <= 0.05) THEN 'quality_worsened' ELSE 'quality_stable' END AS trend_status
    FROM (SELECT *, coalesce(o2, 0) - coalesce(o1, 0) AS od, coalesce(g1, 0) - coalesce(g2, 0) AS gd FROM successive WHERE a2 IS NOT NULL)""",
)
def quality_trend(spark, d):
    c = F.col
    return successive(spark, d).select("site_id", "stream_id", "window_start", D.quality_trend(c("a1"), c("a2"), c("o1"), c("o2"), c("g1"), c("g2")).alias("trend_status"))


V.CTES["month_winner"] = "SELECT site_id, point_class, window_start, stream_id FROM (SELECT *, row_number() OVER (PARTITION BY site_id, point_class, window_start ORDER BY mean_value DESC, stream_id DESC) AS k FROM coarse_month JOIN inventory USING (site_id, stream_id)) WHERE k = 1"


@query(
    "rank_stability",
    "SELECT * FROM (SELECT site_id, point_class, window_start, stream_id AS first_stream_id, lead(stream_id) OVER w AS second_stream_id, CASE WHEN stream_id = lead(stream_id) OVER w THEN 'same_winner' ELSE 'winner_changed' END AS stability_status FROM month_winner WINDOW w AS (PARTITION BY site_id, point_class ORDER BY window_start)) WHERE second_stream_id IS NOT NULL",
)
def rank_stability(spark, d):
    monthly = A.summarize(V.obs_coarse(spark, d), "month").join(V.inventory(spark, d).select("site_id", "stream_id", "point_class"), ["site_id", "stream_id"])
    best = tools.rank_window(monthly, ["site_id", "point_class", "window_start"])
    after = F.lead("stream_id").over(Window.partitionBy("site_id", "point_class").orderBy("window_start"))
    rows = best.select("site_id", "point_class", "window_start", F.col("stream_id").alias("first_stream_id"), after.alias("second_stream_id")).where("second_stream_id is not null")
    return rows.withColumn("stability_status", D.rank_stability(F.col("first_stream_id"), F.col("second_stream_id")))


V.CTES["policy"] = """SELECT * EXCLUDE (k, lead_rank) FROM (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY lead_rank, offset_seconds, requested_ts) AS k FROM (
    SELECT stream_id, requested_ts, observed_ts, value, exact_match_found, offset_seconds, CASE WHEN exact_match_found AND step = 0 THEN 0 WHEN NOT exact_match_found THEN 1 ELSE 2 END AS lead_rank FROM (
      SELECT l.*, o.ts AS observed_ts, round(o.value, 4) AS value, o.ts = requested_ts AS exact_match_found, round(abs(date_diff('microsecond', o.ts, requested_ts)) / 1e6, 3) AS offset_seconds,
        row_number() OVER (PARTITION BY l.stream_id, step ORDER BY abs(date_diff('microsecond', o.ts, requested_ts)), o.ts, o.value) AS j
      FROM (SELECT stream_id, step, date_trunc('minute', first_ts) + step * INTERVAL 1 MINUTE AS requested_ts FROM fine_quality, (SELECT unnest(range(-4, 5)) AS step)) l JOIN obs_fine o USING (stream_id)) WHERE j = 1)) WHERE k = 1"""


def policy(spark, d):
    """The instant to ask for around a stream's first minute: exact at the minute, else the nearest miss within four minutes, else an exact one."""
    obs = V.obs_fine(spark, d)
    start = obs.groupBy("stream_id").agg(K.minute_of(F.min("ts")).alias("base"))
    ladder = start.select("stream_id", "base", F.explode(F.sequence(F.lit(-4), F.lit(4))).alias("step"))
    asked = ladder.select("stream_id", (F.col("base") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("step"))).alias("probe_ts"), "step", F.xxhash64("stream_id", "step").alias("probe_id"))
    near = asof.nearest(obs, asked).join(asked.select("probe_id", "step"), "probe_id")
    first = F.when(F.col("exact_match_found") & (F.col("step") == 0), 0).when(~F.col("exact_match_found"), 1).otherwise(2)
    best = near.groupBy("stream_id").agg(F.min(F.struct(first.alias("f"), "offset_seconds", F.col("probe_ts").alias("requested_ts"), "observed_ts", "value", "exact_match_found")).alias("b"))
    return best.select("stream_id", "b.requested_ts", "b.observed_ts", "b.value", "b.exact_match_found", "b.offset_seconds")


@query("timestamp_policy", "SELECT * FROM policy")
def timestamp_policy(spark, d):
    return policy(spark, d)


V.CTES["committed"] = f"""SELECT p.stream_id, exact_match_found, offset_seconds, CASE WHEN low OR far THEN 'abstain' WHEN good THEN 'answer' ELSE 'abstain' END AS action, CASE WHEN low THEN 'low_coverage' WHEN far THEN 'long_gap' WHEN good THEN 'healthy' ELSE 'marginal_quality' END AS reason
  FROM policy p JOIN (SELECT stream_id, observed_fraction < abstain_observed_fraction_below AS low, {RATIO} > abstain_gap_ratio_above AS far, observed_fraction >= answer_observed_fraction_at_least AND {RATIO} <= answer_gap_ratio_at_most AS good FROM fine_quality, fine_reference) USING (stream_id)"""


def committed(spark, d):
    q = A.quality(V.obs_fine(spark, d))
    rows = q.withColumn("gap_ratio", T.gap_ratio()).crossJoin(F.broadcast(T.quality_reference(q))).select("stream_id", D.quality_decision().alias("d"))
    return policy(spark, d).join(rows, "stream_id").select("stream_id", "exact_match_found", "offset_seconds", "d.action", "d.reason")


@query(
    "reporting_commitment",
    """SELECT stream_id, CASE WHEN action = 'abstain' THEN 'abstain' WHEN exact_match_found OR offset_seconds <= 120 THEN 'answer' ELSE 're_clarify' END AS combined,
    CASE WHEN action = 'abstain' THEN reason WHEN exact_match_found THEN 'exact_timestamp' WHEN offset_seconds <= 120 THEN 'nearest_but_acceptable' ELSE 'timestamp_too_imprecise' END AS combined_reason,
    CASE WHEN action = 'abstain' THEN 'abstain' WHEN exact_match_found OR offset_seconds <= 30 THEN 'answer' ELSE 're_clarify' END AS strict,
    CASE WHEN exact_match_found OR offset_seconds <= 120 THEN 'answer' ELSE 're_clarify' END AS by_timestamp, CASE WHEN action = 'answer' THEN 'answer' ELSE 'abstain' END AS by_quality FROM committed""",
)
def reporting_commitment(spark, d):
    a, r, e, o = (F.col(x) for x in ("action", "reason", "exact_match_found", "offset_seconds"))
    has = F.lit(True)
    rows = committed(spark, d).select("stream_id", D.combined_commitment(a, r, has, e, o).alias("c"), D.strict_commitment(a, r, has, e, o).alias("s"), D.timestamp_commitment(e, o, 120.0).alias("t"), D.quality_commitment(a, r).alias("q"))
    return rows.select("stream_id", F.col("c.action").alias("combined"), F.col("c.reason").alias("combined_reason"), F.col("s.action").alias("strict"), F.col("t.action").alias("by_timestamp"), F.col("q.action").alias("by_quality"))


@query(
    "resolution_status",
    """SELECT stream_id, status, CASE WHEN action = 'abstain' THEN 'abstain' WHEN status <> 'ambiguous_nearest' THEN 'answer' ELSE 're_clarify' END AS report,
    CASE WHEN action = 'abstain' THEN reason WHEN status = 'exact' THEN 'exact_timestamp' WHEN status = 'unique_nearest' THEN 'nearest_but_acceptable' ELSE 'timestamp_too_imprecise' END AS report_reason
    FROM (SELECT *, CASE WHEN exact_match_found THEN 'exact' WHEN offset_seconds <= 30 THEN 'unique_nearest' ELSE 'ambiguous_nearest' END AS status FROM committed)""",
)
def resolution_status(spark, d):
    rows = committed(spark, d).withColumn("status", D.resolution_status(F.col("exact_match_found"), F.col("offset_seconds")))
    return rows.select("stream_id", "status", D.reportability(F.col("status"), F.col("action"), F.col("reason")).alias("c")).select("stream_id", "status", F.col("c.action").alias("report"), F.col("c.reason").alias("report_reason"))


@query(
    "period_infer_shift",
    """SELECT site_id, stream_id, window_start, window_end, CASE WHEN abs(d - 1) < 0.01 THEN 'day' WHEN abs(d - 7) < 0.01 THEN 'week' ELSE 'month' END AS inferred, window_start - (window_end - window_start) AS previous_start, window_end + (window_end - window_start) AS next_end
    FROM (SELECT *, date_diff('microsecond', window_start, window_end) / 1e6 / 86400 AS d FROM coarse_week)""",
)
def period_infer_shift(spark, d):
    w = A.summarize(V.obs_coarse(spark, d), "week")
    s, e = "window_start", "window_end"
    return w.select("site_id", "stream_id", s, e, K.infer_period(s, e).alias("inferred"), K.shifted(s, s, e, -1).alias("previous_start"), K.shifted(e, s, e, 1).alias("next_end"))


@query(
    "adjacent_window",
    """SELECT request_id, direction, mean_value, count FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY direction DESC) AS k FROM (
      SELECT r.request_id, direction, CAST(sum(CAST(value AS DECIMAL(20, 6))) AS DOUBLE) / count(value) AS mean_value, count(value) AS count
      FROM (SELECT stream_id || '@' || strftime(window_start, '%Y%m%d') AS request_id, stream_id, direction, CASE direction WHEN 'previous' THEN window_start - INTERVAL 1 DAY ELSE window_start + INTERVAL 1 DAY END AS a,
            CASE direction WHEN 'previous' THEN window_start ELSE window_start + INTERVAL 2 DAY END AS b FROM fine_day, (SELECT unnest(['previous', 'next']) AS direction)) r
      JOIN obs_fine o ON o.stream_id = r.stream_id AND ts >= a AND ts < b GROUP BY 1, 2)) WHERE k = 1""",
)
def adjacent_window(spark, d):
    """The day before each stored day, or the day after it where the one before is empty."""
    obs = V.obs_fine(spark, d)
    from tidegauge.operators import episodes

    days = A.summarize(obs, "day").select(F.concat_ws("@", "stream_id", F.date_format("window_start", "yyyyMMdd")).alias("request_id"), "stream_id", "window_start", (F.col("window_start") + F.make_dt_interval(F.lit(1))).alias("window_end"))
    return episodes.adjacent_window(obs, days, digits=None).select("request_id", "direction", "mean_value", "count")
