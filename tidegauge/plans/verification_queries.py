"""Queries that run sequences of calls, and verify calls and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.functions import typed as J
from tidegauge.functions.columns import exact_mean, iso_text
from tidegauge.operators import aggregates as A
from tidegauge.operators import reports
from tidegauge.operators import thresholds as T
from tidegauge.operators import verification as W
from tidegauge.operators.sequences import Tools, execute
from tidegauge.plans import views as V
from tidegauge.plans.registry import query
from tidegauge.tables import materialise

# A task for each fine stream: the mean of its first stored week. By the stream's number the calls are exact, moved to the stream's first observation, a day off, behind a look-up, on
# another stream, or none; the answer is what the last call gave, in some with a status in another case, and some name their evidence.
V.CTES["first_week"] = """SELECT stream_id, substr(stream_id, 5)::BIGINT AS k, window_start AS ws, window_end AS we, round(mean_value, 4) AS gold, (SELECT min(ts) FROM obs_fine o WHERE o.stream_id = w.stream_id AND value IS NOT NULL) AS first_ts
  FROM (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY window_start) AS n FROM fine_week) w WHERE n = 1"""
V.CTES["asked_windows"] = """SELECT *, k % 2 = 0 AS movable, CASE k % 6 WHEN 1 THEN first_ts WHEN 2 THEN ws + INTERVAL 1 DAY ELSE ws END AS s, CASE k % 6 WHEN 1 THEN first_ts + (we - ws) ELSE we END AS e FROM first_week"""
V.CTES["asked_means"] = """SELECT w.*, CASE WHEN k % 6 <> 5 THEN (SELECT round(CAST(sum(CAST(value AS DECIMAL(20, 6))) AS DOUBLE) / count(*), 4) FROM obs_fine o WHERE o.stream_id = w.stream_id AND ts >= s AND ts < e AND isfinite(value)) END AS mean FROM asked_windows w"""


def first_weeks(spark, d):
    obs = V.obs_fine(spark, d)
    weekly = A.summarize(obs, "week")
    first = weekly.groupBy("stream_id").agg(F.min_by(F.struct("window_start", "window_end", "mean_value"), "window_start").alias("w"))
    seen = obs.where("value is not null").groupBy("stream_id").agg(F.min("ts").alias("first_ts"))
    rows = first.join(seen, "stream_id").select("stream_id", F.substr("stream_id", F.lit(5)).cast("bigint").alias("k"), F.col("w.window_start").alias("ws"), F.col("w.window_end").alias("we"), F.round("w.mean_value", 4).alias("gold"), "first_ts")
    kind = F.col("k") % 6
    length = F.col("we") - F.col("ws")
    return rows.withColumns({
        "s": F.when(kind == 1, F.col("first_ts")).when(kind == 2, F.col("ws") + F.make_dt_interval(F.lit(1))).otherwise(F.col("ws")),
        "e": F.when(kind == 1, F.col("first_ts") + length).otherwise(F.col("we")),
    })


def arguments(stream, start, end):
    return J.written(stream_id=stream, window_start=iso_text(start), window_end=iso_text(end), period=F.lit("week"))


def verified(spark, d):
    obs = V.obs_fine(spark, d)
    rows = materialise(first_weeks(spark, d), "first-weeks")
    k, stream = F.col("k"), F.col("stream_id")
    inside = obs.join(rows.select("stream_id", "s", "e"), "stream_id").where("ts >= s and ts < e and value is not null and not isnan(value)")
    means = inside.groupBy("stream_id").agg(F.round(exact_mean("value"), 4).alias("mean"))
    rows = rows.join(means, "stream_id", "left")
    movable = F.when(k % 2 == 0, "window_mean_lookup").otherwise("point_mean")
    variant = F.array(F.struct(F.lit("c1").alias("call_id"), F.lit("aggregate_window").alias("tool_name"), arguments(stream, F.col("ws"), F.col("we")).alias("arguments")))
    tasks = rows.select(
        stream.alias("task_id"), movable.alias("family"), F.lit("week").alias("period"),
        J.written(stream_id=stream, mean_value=F.col("gold"), status=F.lit("ok"), window_start=iso_text("ws"), window_end=iso_text("we")).alias("gold"),
        W.texts("stream_id", "mean_value", "status").alias("required"), F.create_map(F.lit("mean_value"), F.lit(0.01)).alias("tolerance"),
        F.array(stream).alias("streams"), W.texts("aggregate_window").alias("tools"), F.array(variant).alias("variants"),
    )
    asked = F.when(k % 6 == 4, F.concat(stream, F.lit("_b"))).otherwise(stream)
    output = F.to_json(F.struct(asked.alias("stream_id"), F.col("mean").alias("mean_value")))
    aggregate = F.struct(F.lit(2).alias("position"), F.lit("aggregate_window").alias("tool_name"), arguments(asked, F.col("s"), F.col("e")).alias("arguments"), output.alias("output"))
    look = F.struct(F.lit(1).alias("position"), F.lit("lookup_observation").alias("tool_name"), J.written(stream_id=stream, timestamp=iso_text("ws"), mode=F.lit("nearest")).alias("arguments"), F.to_json(F.struct(F.lit(1).alias("n"))).alias("output"))
    calls = rows.where(k % 6 != 5).select(stream.alias("task_id"), F.explode(F.when(k % 6 == 3, F.array(aggregate, look)).otherwise(F.array(aggregate))).alias("c")).select("task_id", "c.*")
    status = F.when(k % 5 == 0, "OK").otherwise("ok")
    final = F.when(k % 6 != 5, F.to_json(F.struct(stream.alias("stream_id"), F.col("mean").alias("mean_value"), status.alias("status"))))
    evidence = F.when(k % 4 != 0, F.to_json(F.struct(F.array(F.when(k % 8 == 1, F.lit("none")).otherwise(stream)).alias("stream_ids"))))
    return W.verify(tasks, calls, rows.select(stream.alias("task_id"), final.alias("final"), evidence.alias("evidence")), obs)


V.CTES["verified_calls"] = """SELECT task_id, CASE WHEN good THEN 'accomplished' WHEN task_score > 0 THEN 'partially_accomplished' ELSE 'not_accomplished' END AS label,
      CASE WHEN good AND process_score = 1 THEN 'accomplished' WHEN process_score + task_score > 0 THEN 'partially_accomplished' ELSE 'not_accomplished' END AS strict_label,
      process_score, core_score AS final_score, core_score, 1.0 AS reporting_score, evidence_score, temporal_score, 1.0 AS phase_score, round((evidence_score + 1) / 2, 4) AS grounding_score, round(task_score, 4) AS task_score,
      concat_ws(',', CASE WHEN k % 6 = 5 THEN 'missing_tool:aggregate_window' END, CASE WHEN NOT placed THEN 'call_sequence_mismatch' END, CASE WHEN temporal_score = 0 THEN 'temporal_mismatch:aggregate_window:window_start,window_end,period' END,
        CASE WHEN k % 6 = 5 THEN 'missing_answer_fact:final_answer' END, CASE WHEN k % 6 <> 5 AND mean IS NULL THEN 'missing_final_field:mean_value' WHEN k % 6 <> 5 AND NOT mean_ok THEN 'numeric_mismatch:mean_value' END, CASE WHEN k % 6 <> 5 AND k % 5 = 0 THEN 'value_mismatch:status' END,
        CASE WHEN evidence_score = 0 THEN 'missing_evidence:' || task_id END) AS issues
    FROM (SELECT *, round(core, 4) AS core_score, CASE WHEN k % 6 = 5 THEN 0.0 ELSE 1.0 END AS process_score, core = 1 AND evidence_score = 1 AND temporal_score = 1 AS good, (core + (evidence_score + 1) / 2 + temporal_score + 1) / 4 AS task_score
      FROM (SELECT *, CASE WHEN k % 6 = 5 THEN 0.0 ELSE (1 + mean_ok::INT + (k % 5 <> 0)::INT) / 3.0::DOUBLE END AS core,
        CASE WHEN k % 4 <> 0 THEN (k % 8 <> 1)::INT WHEN k % 6 IN (4, 5) THEN 0 ELSE 1 END::DOUBLE AS evidence_score
        FROM (SELECT stream_id AS task_id, *, k % 6 NOT IN (4, 5) AND s = ws AND e = we OR k % 6 = 1 AND movable OR k % 6 = 4 AS in_time,
          CASE WHEN k % 6 = 5 THEN 0.0 WHEN s = ws AND e = we OR near_way THEN 1.0 ELSE 0.0 END AS temporal_score,
          coalesce(abs(mean - CASE WHEN near_way THEN mean ELSE gold END) <= 0.01, false) AS mean_ok, k % 6 IN (0, 1, 2) AND (s = ws AND e = we OR near_way AND mean IS NOT NULL) AS placed
          FROM (SELECT *, movable AND k % 6 NOT IN (4, 5) AND (s = ws AND e = we OR s = first_ts AND e = first_ts + (we - ws)) AS near_way FROM asked_means))))"""


@query("verify_calls", "SELECT * FROM verified_calls")
def verify_calls(spark, d):
    out = verified(spark, d)
    return out.withColumn("issues", F.array_join("issues", ","))


@query(
    "failure_report",
    """SELECT what, value, count(*) AS n FROM (SELECT 'label' AS what, label AS value FROM verified_calls UNION ALL SELECT 'category', c.value FROM verified_calls,
      (VALUES ('missing_tool:', 'process_required_tool_missing'), ('call_sequence_mismatch', 'process_call_sequence_mismatch'), ('temporal_mismatch:', 'temporal_contract_mismatch'), ('missing_answer_fact:', 'final_answer_content_missing'), ('missing_evidence:', 'grounding_evidence_missing')) AS c(part, value) WHERE contains(issues, part)
      UNION ALL SELECT 'category', 'other' FROM verified_calls WHERE contains(issues, 'missing_final_field') OR contains(issues, 'numeric_mismatch') OR contains(issues, 'value_mismatch')) GROUP BY 1, 2""",
)
def failure_report(spark, d):
    """How many of the verified tasks have each label and each category of issues."""
    none = F.array().cast("array<string>")
    parts = {f"{p}_issues": none for p in ("phase", "process", "temporal", "final")}
    return reports.report(reports.failures(verified(spark, d).withColumns({"error": F.lit(None).cast("string"), "traced": F.lit(True), **parts})))


# ---- sequences of calls on the real tools: a site's and class's points, their January compared and ranked by references, the winner's observation nearest to mid-January


def january_calls(spark, d):
    groups = V.inventory(spark, d).groupBy("site_id", "point_class").agg(F.count("*").alias("n")).where("n >= 2")
    span = {"window_start": F.lit("1995-01-01T00:00:00"), "window_end": F.lit("1995-02-01T00:00:00"), "period": F.lit("custom"), "metric": F.lit("mean_value")}
    first, second = (F.lit(f"$c1.stream_ids[{k}]") for k in (0, 1))

    def call(position, tool, call_id=None, **arguments):
        return F.struct(F.lit(position).alias("position"), F.lit(call_id).cast("string").alias("call_id"), F.lit(tool).alias("tool_name"), J.written(**arguments).alias("arguments"))

    ranked = call(4, "rank_window", "best", stream_ids=F.array(first, second, F.lit("$c1.points[1].stream_id"), F.lit("$nothing.here")), topk=F.lit(2), **span)
    calls = F.array(
        call(1, "list_points", site_id=F.col("site_id"), point_class=F.col("point_class")),
        call(2, "aggregate_window", stream_id=first, **span),
        call(3, "compare_window", left_stream_id=first, right_stream_id=second, **span),
        ranked,
        call(5, "lookup_observation", stream_id=F.lit("$best.ranked_streams[0].stream_id"), timestamp=F.lit("1995-01-15"), mode=F.lit("nearest")),
        call(6, "inspect_quality", stream_id=F.lit("$c3.winning_stream_id")),
        call(7, "unheard_of", a=F.lit("$c1.count")),
    )
    return groups.select(F.concat_ws("/", "site_id", "point_class").alias("task_id"), F.explode(calls).alias("c")).select("task_id", "c.*")


def store(spark, d):
    obs = materialise(V.obs_coarse(spark, d), "observations")
    quality = materialise(A.quality(obs), "quality")
    aggregates = materialise(A.summarize(obs, "week").unionByName(A.summarize(obs, "month")), "aggregates")
    none = spark.createDataFrame([], "alias string, point_class string")
    reference = materialise(T.quality_reference(quality), "reference")
    return Tools(V.inventory(spark, d), obs, aggregates, quality, none, reference, reference.withColumn("period", F.lit("week")))


V.CTES["january"] = """SELECT site_id, point_class, stream_id, row_number() OVER (PARTITION BY site_id, point_class ORDER BY stream_id) AS k, count(*) OVER (PARTITION BY site_id, point_class) AS size,
  (SELECT CASE WHEN count(*) > 0 THEN round(CAST(sum(CAST(value AS DECIMAL(20, 6))) AS DOUBLE) / count(*), 4) END FROM obs_coarse o WHERE o.stream_id = i.stream_id AND ts >= TIMESTAMP '1995-01-01' AND ts < TIMESTAMP '1995-02-01') AS mean FROM inventory i"""
V.CTES["january_two"] = """SELECT a.site_id || '/' || a.point_class AS task_id, a.size, a.stream_id AS a, b.stream_id AS b, a.mean AS x, b.mean AS y, CASE WHEN a.mean IS NULL OR b.mean IS NULL THEN NULL WHEN a.mean > b.mean THEN a.stream_id ELSE b.stream_id END AS winner,
  CASE WHEN a.mean IS NULL AND b.mean IS NULL THEN NULL WHEN b.mean IS NULL OR a.mean > b.mean OR a.mean = b.mean AND a.stream_id > b.stream_id THEN a.stream_id ELSE b.stream_id END AS best
  FROM january a JOIN january b ON a.site_id = b.site_id AND a.point_class = b.point_class AND a.k = 1 AND b.k = 2"""


@query(
    "call_sequence_tools",
    """SELECT task_id, 1 AS position, size::VARCHAR AS answer FROM january_two UNION ALL SELECT task_id, 2, CAST(x AS DECIMAL(20, 4))::VARCHAR FROM january_two UNION ALL SELECT task_id, 3, winner FROM january_two UNION ALL SELECT task_id, 4, best FROM january_two
    UNION ALL SELECT task_id, 5, (SELECT strftime(arg_min(ts, struct_pack(p := abs(date_diff('microsecond', ts, TIMESTAMP '1995-01-15')), q := ts)), '%Y-%m-%d') FROM obs_coarse o WHERE o.stream_id = best) FROM january_two
    UNION ALL SELECT task_id, 6, CAST(round(observed_fraction, 4) AS DECIMAL(20, 4))::VARCHAR FROM january_two LEFT JOIN coarse_quality q ON q.stream_id = winner UNION ALL SELECT task_id, 7, NULL FROM january_two""",
)
def call_sequence_tools(spark, d):
    done = execute(january_calls(spark, d), store(spark, d).all(), steps=7)
    out = J.fields("output")
    number = lambda name: J.number_of(out[name]).cast("decimal(20,4)").cast("string")
    answer = (
        F.when(F.col("position") == 1, out["count"]).when(F.col("position") == 2, number("mean_value")).when(F.col("position") == 3, J.text_of(out["winning_stream_id"]))
        .when(F.col("position") == 4, J.text_of(J.at_path(F.col("output"), F.lit("ranked_streams[0].stream_id")))).when(F.col("position") == 5, F.substr(J.text_of(out["observed_timestamp"]), F.lit(1), F.lit(10))).when(F.col("position") == 6, number("observed_fraction"))
    )
    return done.select("task_id", "position", answer.alias("answer"))
