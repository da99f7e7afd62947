"""Queries on tasks: calls and their scores, neighbouring windows, requests in words, summaries, checks of contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.functions import columns as K
from tidegauge.functions import decisions as D
from tidegauge.functions import texts as X
from tidegauge.operators import aggregates as A
from tidegauge.operators import audit, episodes, scoring, selection, tools
from tidegauge.operators import summaries as S
from tidegauge.plans import views as V
from tidegauge.plans.audit_queries import evidence
from tidegauge.plans.registry import query
from tidegauge.plans.tool_queries import committed

DAY_ID = "stream_id || '@' || strftime(window_start, '%Y%m%d')"


def days(spark, d):
    """Each stored day as a request."""
    stored = A.summarize(V.obs_fine(spark, d), "day")
    return stored.select(F.concat_ws("@", "stream_id", F.date_format("window_start", "yyyyMMdd")).alias("request_id"), "site_id", "stream_id", "window_start", (F.col("window_start") + F.make_dt_interval(F.lit(1))).alias("window_end"))


# ---- neighbouring windows

V.CTES["near_days"] = f"""SELECT {DAY_ID} AS request_id, stream_id, site_id, place, ['previous', 'next'][place + 1] AS direction, window_start + (2 * place - 1) * INTERVAL 1 DAY AS a, window_start + 2 * place * INTERVAL 1 DAY AS b FROM fine_day, (SELECT unnest([0, 1]) AS place)"""


@query(
    "adjacent_compare",
    """SELECT request_id, direction, winning_stream_id FROM (SELECT n.request_id, n.direction, CASE WHEN l.mean_value > r.mean_value THEN l.stream_id ELSE r.stream_id END AS winning_stream_id, row_number() OVER (PARTITION BY n.request_id ORDER BY place) AS k
    FROM near_days n JOIN fine_day l ON l.stream_id = n.stream_id AND l.window_start = n.a JOIN fine_day r ON r.stream_id = 'usr_' || (n.stream_id[5:]::BIGINT + 1) AND r.window_start = n.a) WHERE k = 1""",
)
def adjacent_compare(spark, d):
    """Each stored day's stream against the one with the next number, the day before or after."""
    after = F.concat(F.lit("usr_"), (F.substr("stream_id", F.lit(5)).cast("bigint") + 1).cast("string"))
    asked = days(spark, d).select("request_id", F.col("stream_id").alias("left_stream_id"), after.alias("right_stream_id"), "window_start", "window_end")
    return episodes.adjacent_compare(V.obs_fine(spark, d), asked, digits=None).select("request_id", "direction", "winning_stream_id")


V.CTES["site_days"] = "SELECT DISTINCT site_id, window_start FROM fine_day"


@query(
    "adjacent_rank",
    """SELECT request_id, direction, stream_id FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY place, mean_value DESC, stream_id DESC) AS k FROM (
      SELECT s.site_id || '@' || strftime(s.window_start, '%Y%m%d') AS request_id, place, CASE place WHEN 0 THEN 'previous' ELSE 'next' END AS direction, f.stream_id, f.mean_value FROM site_days s, (SELECT unnest([0, 1]) AS place) p, fine_day f
      WHERE f.site_id = s.site_id AND f.window_start = s.window_start + (2 * place - 1) * INTERVAL 1 DAY)) WHERE k = 1""",
)
def adjacent_rank(spark, d):
    """The best stream of each site on the day before each stored day, or after it."""
    obs = V.obs_fine(spark, d)
    asked = days(spark, d).select("site_id", "window_start", "window_end").distinct()
    windows = asked.select(F.concat_ws("@", "site_id", F.date_format("window_start", "yyyyMMdd")).alias("request_id"), F.col("site_id").alias("group"), "window_start", "window_end")
    members = obs.select(F.col("site_id").alias("group"), "stream_id").distinct()
    return episodes.adjacent_rank(obs, windows, members, digits=None).select("request_id", "direction", "stream_id")


V.CTES["near_metrics"] = V.quality_sql("(SELECT o.*, n.request_id || '|' || n.place AS request_id FROM near_days n JOIN obs_fine o ON o.stream_id = n.stream_id AND o.ts >= n.a AND o.ts < n.b)", "request_id")


@query(
    "adjacent_quality",
    """SELECT request_id, direction, observed_fraction, gap_ratio FROM (SELECT n.request_id, direction, observed_fraction, gap_ratio, row_number() OVER (PARTITION BY n.request_id ORDER BY place) AS k
    FROM near_days n JOIN (SELECT *, round(longest_gap_seconds / nullif(median_step_seconds, 0), 4) AS gap_ratio FROM near_metrics) m ON m.request_id = n.request_id || '|' || n.place WHERE observed_fraction IS NOT NULL OR gap_ratio IS NOT NULL) WHERE k = 1""",
)
def adjacent_quality(spark, d):
    return episodes.adjacent_quality(V.obs_fine(spark, d), days(spark, d)).select("request_id", "direction", "observed_fraction", "gap_ratio")


@query("alternate_point", "SELECT stream_id, (SELECT min(o.stream_id) FROM inventory o WHERE o.site_id = i.site_id AND o.point_class = i.point_class AND o.stream_id <> i.stream_id) AS alternate FROM inventory i")
def alternate_point(spark, d):
    return S.other_member(V.inventory(spark, d).select("site_id", "point_class", "stream_id"), ["site_id", "point_class"], "stream_id").select("stream_id", "alternate")


@query(
    "earlier_or_later",
    "SELECT o_custkey, CASE o_custkey % 3 WHEN 0 THEN arg_max(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) WHEN 1 THEN arg_min(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) END AS o_orderkey FROM orders GROUP BY 1",
)
def earlier_or_later(spark, d):
    text = F.when(F.col("o_custkey") % 3 == 0, "The later of the two").when(F.col("o_custkey") % 3 == 1, "the earlier of the two").otherwise("either")
    rows = V.table(spark, d, "orders").select("o_custkey", "o_orderkey", text.alias("text"), F.struct("o_orderdate", "o_orderkey").alias("at"))
    return S.earlier_or_later(rows, "o_custkey", "text", "at", "o_orderkey")


@query("month_shift", "SELECT stream_id, window_start, CAST(window_start - INTERVAL 1 MONTH AS TIMESTAMP) AS previous_start, CAST(window_start + INTERVAL 1 MONTH AS TIMESTAMP) AS next_start FROM coarse_month")
def month_shift(spark, d):
    months = A.summarize(V.obs_coarse(spark, d), "month")
    return months.select("stream_id", "window_start", *[F.add_months("window_start", n).cast("timestamp_ntz").alias(name) for n, name in ((-1, "previous_start"), (1, "next_start"))])


# ---- calls


@query(
    "call_sequence_run",
    """SELECT o_orderkey AS task_id, position, call_id, CASE position WHEN 1 THEN CAST(n_nationkey AS VARCHAR) WHEN 2 THEN n_name END AS output FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey,
    (SELECT unnest([1, 2, 3]) AS position, unnest(['c1', 'named', 'c3']) AS call_id)""",
)
def call_sequence_run(spark, d):
    """Three calls of each order: its customer's nation, that nation's name through a nested reference, and a tool that isn't there."""
    o, c, n = (V.table(spark, d, t) for t in ("orders", "customer", "nation"))
    both = F.array(
        F.struct(F.lit(1).alias("position"), F.lit(None).cast("string").alias("call_id"), F.lit("customer").alias("tool_name"), F.create_map(F.lit("id"), F.col("o_custkey").cast("string")).alias("arguments")),
        F.struct(F.lit(2).alias("position"), F.lit("named").alias("call_id"), F.lit("nation").alias("tool_name"), F.create_map(F.lit("id"), F.lit("$c1.places[1].nation")).alias("arguments")),
        F.struct(F.lit(3).alias("position"), F.lit(None).cast("string").alias("call_id"), F.lit("unknown").alias("tool_name"), F.create_map(F.lit("id"), F.lit("$named.name")).alias("arguments")),
    )
    calls = o.select(F.col("o_orderkey").alias("task_id"), F.explode(both).alias("c")).select("task_id", "c.*")

    def nation_of(asked):
        out = F.to_json(F.struct(F.array(F.struct(F.lit("none").alias("nation")), F.struct(F.col("c_nationkey").cast("string").alias("nation"))).alias("places")))
        return asked.join(c.select(F.col("c_custkey").cast("string").alias("_id"), out.alias("output")), F.col("arguments")["id"] == F.col("_id"))

    def name_of(asked):
        return asked.join(F.broadcast(n.select(F.col("n_nationkey").cast("string").alias("_id"), F.to_json(F.struct(F.col("n_name").alias("name"))).alias("output"))), F.col("arguments")["id"] == F.col("_id"))

    done = tools.execute_sequences(calls, {"customer": nation_of, "nation": name_of}, steps=3)
    answer = F.when(F.col("position") == 1, F.get_json_object("output", "$.places[1].nation")).when(F.col("position") == 2, F.get_json_object("output", "$.name"))
    return done.select("task_id", "position", "call_id", answer.alias("output"))


@query("call_key", "SELECT o_orderkey, TRUE AS same, FALSE AS other FROM orders")
def call_key(spark, d):
    """Calls with the same arguments in another order have one key, calls with other values another one."""
    o = V.table(spark, d, "orders")
    a, b = (F.lit("status"), F.col("o_orderstatus")), (F.lit("priority"), F.col("o_orderpriority"))
    first, second, third = (X.call_key(F.lit("find"), F.create_map(*x)) for x in (a + b, b + a, a))
    return o.select("o_orderkey", (first == second).alias("same"), (first == third).alias("other"))


@query("json_values", "SELECT event_id, 'usr_' || user_id || ',' || 'usr_' || (user_id + 1) AS ids, [event_id::DOUBLE, -1.5::DOUBLE][2] AS second_number, strftime(ts, '%Y-%m-%d') AS first_time FROM events")
def json_values(spark, d):
    """Ids, numbers and times found in JSON text at any depth."""
    e = V.table(spark, d, "events")
    user = lambda n: F.concat(F.lit("usr_"), (F.col("user_id") + n).cast("string")).alias("stream_id")
    json = F.to_json(F.struct(user(0), F.struct(F.array(F.struct(user(1))).alias("rows"), F.lit("id_7").alias("other")).alias("inner")))
    text = F.concat(F.lit("event "), F.col("event_id").cast("string"), F.lit(" fell by -1.5 on "), F.date_format("ts", "yyyy-MM-dd"))
    return e.select("event_id", F.concat_ws(",", X.ids_in(json)).alias("ids"), F.element_at(X.numbers_in(text), 2).alias("second_number"), F.element_at(X.times_in(text), 1).alias("first_time"))


# ---- scores

V.CTES["task_scores"] = """SELECT o_orderkey AS task_id, o_orderpriority, (o_orderkey % 2)::DOUBLE AS process, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE (o_orderkey % 4) / 3.0::DOUBLE END AS core, CASE WHEN o_orderkey % 3 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS evidence,
  1.0::DOUBLE AS reporting, CASE WHEN o_orderkey % 5 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS timing, CASE WHEN o_orderkey % 7 = 0 THEN 0.25 ELSE 1.0 END::DOUBLE AS phases FROM orders"""
V.CTES["verdicts"] = """SELECT task_id, o_orderpriority, grounding, task, CASE WHEN good THEN 'accomplished' WHEN task > 0 THEN 'partially_accomplished' ELSE 'not_accomplished' END AS label,
  CASE WHEN good AND process = 1 THEN 'accomplished' WHEN process + task > 0 THEN 'partially_accomplished' ELSE 'not_accomplished' END AS strict_label
  FROM (SELECT *, (evidence + reporting) / 2 AS grounding, (core + (evidence + reporting) / 2 + timing + phases) / 4 AS task, core = 1 AND evidence = 1 AND reporting = 1 AND timing = 1 AND phases = 1 AS good FROM task_scores)"""


def verdicts(spark, d):
    o, k = V.table(spark, d, "orders"), F.col("o_orderkey")
    one = F.lit(1.0)
    core = F.when(F.col("o_orderstatus") == "F", one).otherwise((k % 4) / 3.0)
    v = scoring.verdict((k % 2).cast("double"), core, F.when(k % 3 == 0, 0.5).otherwise(one), one, F.when(k % 5 == 0, 0.0).otherwise(one), F.when(k % 7 == 0, 0.25).otherwise(one))
    return o.select(k.alias("task_id"), "o_orderpriority", v.alias("v")).select("task_id", "o_orderpriority", "v.*")


@query("score_verdict", "SELECT task_id, o_orderpriority, round(grounding, 4) AS grounding, round(task, 4) AS task, label, strict_label FROM verdicts")
def score_verdict(spark, d):
    return verdicts(spark, d)


@query("score_summary", "SELECT o_orderpriority, count(*) AS n, round(avg(round(grounding, 4)), 4) AS mean_grounding, round(avg(round(task, 4)), 4) AS mean_task FROM verdicts GROUP BY 1")
def score_summary(spark, d):
    return S.mean_scores(verdicts(spark, d), ["o_orderpriority"], ["grounding", "task"])


@query("label_counts", "SELECT o_orderpriority, CAST(count_if(label = 'accomplished') AS BIGINT) AS n_accomplished, CAST(count_if(strict_label = 'accomplished') AS BIGINT) AS n_strict, bool_and(label = 'accomplished') AS all_accomplished, bool_and(strict_label = 'accomplished') AS all_strict FROM verdicts GROUP BY 1")
def label_counts(spark, d):
    return S.counts_if(verdicts(spark, d), ["o_orderpriority"], {"accomplished": F.col("label") == "accomplished", "strict": F.col("strict_label") == "accomplished"})


@query(
    "score_temporal_variants",
    """SELECT task_id, coalesce(max(CASE WHEN n > 0 THEN hit / n END), 1.0)::DOUBLE AS score FROM (SELECT l_orderkey AS task_id, l_linenumber % 2 AS variant, count(*) FILTER (l_linenumber <> 3) AS n, sum((l_returnflag <> 'R')::INT) FILTER (l_linenumber <> 3) AS hit
    FROM (SELECT l.* REPLACE (CASE WHEN c.l_orderkey IS NULL THEN 'R' ELSE 'N' END AS l_returnflag) FROM lineitem l LEFT JOIN (SELECT DISTINCT l_orderkey, l_shipdate FROM lineitem WHERE l_returnflag <> 'R') c USING (l_orderkey, l_shipdate)) GROUP BY 1, 2) GROUP BY 1""",
)
def score_temporal_variants(spark, d):
    """Odd and even lines are two variants; third lines are samples, which don't count; calls ask for the days of lines that weren't returned."""
    l = V.table(spark, d, "lineitem")
    window = [F.lit("aggregate").alias("tool"), F.col("l_shipdate").alias("window_start"), (F.col("l_shipdate") + F.make_dt_interval(F.lit(1))).alias("window_end")]
    task = F.col("l_orderkey").alias("task_id")
    needs = l.select(task, (F.col("l_linenumber") % 2).alias("variant"), F.when(F.col("l_linenumber") == 3, "c3_sample").otherwise("c1").alias("call_id"), *window)
    return scoring.temporal_best(needs, l.where("l_returnflag <> 'R'").select(task, *window))


@query(
    "relaxed_windows",
    """SELECT task_id, count(*) AS n, min(window_start) AS earliest, max(window_end) AS latest, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT task_id, window_start, window_end, arg_min(w.label, w.k) AS label FROM (
      SELECT task_id, w, w.s AS window_start, w.e AS window_end FROM (SELECT task_id, unnest([struct_pack(k := 1, label := 'exact', s := a, e := b), struct_pack(k := 2, label := 'exact_start_nearest_end', s := a, e := y),
        struct_pack(k := 3, label := 'nearest_start_fixed_duration', s := x, e := x + (b - a)), struct_pack(k := 4, label := 'nearest_start_nearest_end', s := x, e := y)]) AS w
      FROM (SELECT w.*, (SELECT arg_min(ts, struct_pack(p := abs(date_diff('microsecond', ts, a)), q := ts)) FROM obs_fine o WHERE o.stream_id = w.stream_id AND value IS NOT NULL) AS x,
        (SELECT arg_min(ts, struct_pack(p := abs(date_diff('microsecond', ts, b)), q := ts)) FROM obs_fine o WHERE o.stream_id = w.stream_id AND value IS NOT NULL) AS y
        FROM (SELECT stream_id || '@' || strftime(window_start, '%Y%m%d') AS task_id, stream_id, window_start AS a, window_start + INTERVAL 7 DAY AS b FROM fine_week) w)))
      WHERE window_end > window_start GROUP BY 1, 2, 3) GROUP BY 1""",
)
def relaxed_windows(spark, d):
    obs = V.obs_fine(spark, d)
    golds = A.summarize(obs, "week").select(F.concat_ws("@", "stream_id", F.date_format("window_start", "yyyyMMdd")).alias("task_id"), "stream_id", "window_start", (F.col("window_start") + F.make_dt_interval(F.lit(7))).alias("window_end"))
    return scoring.relaxed_windows(obs, golds).groupBy("task_id").agg(F.count("*").alias("n"), F.min("window_start").alias("earliest"), F.max("window_end").alias("latest"), F.array_join(F.array_sort(F.collect_list("label")), ",").alias("labels"))


@query(
    "score_phases",
    """SELECT task_id, CASE WHEN bool_or(good IS NULL) THEN 0.0 ELSE avg(good::INT) END AS score FROM (SELECT l_orderkey AS task_id, l_linenumber, l_partkey, bool_and(l_returnflag <> 'R') FILTER (l_discount <= 0.09) AS good FROM lineitem GROUP BY 1, 2, 3) GROUP BY 1""",
)
def score_phases(spark, d):
    """Each line is a phase, named by its place and part; lines of large discount have no answer."""
    l = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.struct("l_linenumber", "l_partkey").alias("phase"), "l_returnflag", "l_discount")
    answers = l.where("l_discount <= 0.09").groupBy("task_id", "phase").agg(F.bool_and(F.col("l_returnflag") != "R").alias("good"))
    return scoring.phase_score(l.select("task_id", "phase").distinct(), answers)


@query("rescored", "SELECT task_id, 'task' AS field FROM verdicts WHERE task_id % 13 = 0 AND round(task, 4) <> 0.5")
def rescored(spark, d):
    """Stored scores that differ from those computed again; every thirteenth is stored as 0.5."""
    now = verdicts(spark, d).select("task_id", "task", "label")
    stored = now.withColumn("task", F.when(F.col("task_id") % 13 == 0, 0.5).otherwise(F.col("task")))
    return audit.binding(stored, now, "task_id", ["task", "label"]).select("task_id", F.replace("problem", F.lit("differs_"), F.lit("")).alias("field"))


# ---- requests in words


@query(
    "time_in_words",
    """SELECT o_orderkey, CASE k WHEN 0 THEN date_trunc('day', o_orderdate) WHEN 1 THEN date_trunc('day', o_orderdate) + INTERVAL 570 MINUTE - INTERVAL 1 DAY WHEN 2 THEN date_trunc('day', o_orderdate) WHEN 3 THEN date_trunc('month', o_orderdate) END::TIMESTAMP AS window_start,
    CASE k WHEN 0 THEN date_trunc('day', o_orderdate) + INTERVAL 1 DAY WHEN 1 THEN date_trunc('day', o_orderdate) + INTERVAL 570 MINUTE WHEN 2 THEN date_trunc('day', o_orderdate) + INTERVAL 7 DAY WHEN 3 THEN date_trunc('month', o_orderdate) + INTERVAL 1 MONTH END::TIMESTAMP AS window_end,
    ['day', 'custom', 'week', 'month', NULL][k + 1] AS period, k <> 4 AS dated FROM (SELECT *, o_orderkey % 5 AS k FROM orders)""",
)
def time_in_words(spark, d):
    """The time of each request written out and read back from the words."""
    families = ["day_mean_lookup", "relative_24h_mean_lookup", "window_mean_lookup", "window_rank", "other"]
    day = F.date_trunc("day", F.col("o_orderdate"))
    clock = F.col("o_orderdate").cast("date").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(9), F.lit(30))
    o = V.table(spark, d, "orders").select("o_orderkey", F.element_at(F.array(*map(F.lit, families)), (F.col("o_orderkey") % 5 + 1).cast("int")).alias("family"), day.alias("day"), clock.alias("clock"))
    said = F.concat(F.when(F.col("family") == "window_rank", "In ").otherwise("on "), X.time_phrase("family", F.col("day"), F.col("clock"), F.col("clock")))
    told = o.select("o_orderkey", "family", F.coalesce(said, F.lit("no time")).alias("text"))
    rows = told.select("o_orderkey", X.window_in("family", "text").alias("w"), X.has_calendar_reference("text").alias("dated"))
    return rows.select("o_orderkey", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), F.col("w.period").alias("period"), "dated")


@query("class_phrases", """SELECT stream_id, CASE point_class WHEN 'Air_Temperature_Sensor' THEN 'air temperature measurement|air temperature reading|air temperature sensor' WHEN 'Zone_Temperature_Setpoint' THEN 'zone temperature setpoint|zone temperature setting'
    WHEN 'Air_Flow_Sensor' THEN 'air flow measurement|air flow reading|air flow sensor' WHEN 'Max_Flow_Limit' THEN 'max flow limit|max flow threshold' ELSE 'point' END AS phrases, lower(equipment_label) AS label FROM inventory""")
def class_phrases(spark, d):
    i = V.inventory(spark, d)
    return i.select("stream_id", F.array_join(X.class_phrases("point_class"), "|").alias("phrases"), F.element_at(X.label_variants("equipment_label"), 1).alias("label"))


@query("phrase_grounding", "SELECT stream_id, point_class AS value FROM inventory")
def phrase_grounding(spark, d):
    """The class that a request names, by the longest phrase in it."""
    i = V.inventory(spark, d)
    phrases = i.select("point_class").distinct().select(F.col("point_class").alias("value"), F.explode(X.class_phrases("point_class")).alias("phrase"))
    asked = i.select("stream_id", F.concat(F.lit("Which point has the best "), F.element_at(X.class_phrases("point_class"), -1), F.lit(" in "), F.col("site_id"), F.lit("?")).alias("text"))
    return S.longest_hit(S.phrase_hits(asked, "stream_id", "text", phrases), "stream_id").select("stream_id", "value")


@query("task_ids", "SELECT o_orderkey, 'run_' || o_orderstatus || '_' || lpad(CAST(o_orderkey % 90000 AS VARCHAR), 5, '0') AS task_id, o_orderkey % 90000 AS ordinal, replace(replace(o_orderpriority, '-', ' '), 'URGENT', 'NOW') AS priority FROM orders")
def task_ids(spark, d):
    o = V.table(spark, d, "orders").select("*", X.numbered(F.lit("run"), "o_orderstatus", F.col("o_orderkey") % 90000).alias("task_id"))
    return o.select("o_orderkey", "task_id", X.ordinal_of("task_id").alias("ordinal"), X.replaced("o_orderpriority", [("-", " "), ("URGENT", "NOW")]).alias("priority"))


# ---- summaries and contracts


@query("constant_groups", "SELECT l_orderkey, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 1")
def constant_groups(spark, d):
    return S.constant_groups(V.table(spark, d, "lineitem"), ["l_orderkey"], "l_returnflag")


@query("requirement_groups", "SELECT p_brand, count(*) AS n, array_to_string(list_sort(list(p_partkey))[1:8], ',') AS keys FROM part GROUP BY 1")
def requirement_groups(spark, d):
    out = S.requirement_groups(V.table(spark, d, "part"), "p_brand", "p_partkey")
    return out.withColumn("keys", F.array_join(F.col("keys").cast("array<string>"), ","))


@query("last_two", "SELECT o_custkey, lag(o_orderkey) OVER w AS first_key, o_orderkey AS second_key FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1 AND first_key IS NOT NULL")
def last_two(spark, d):
    return S.last_two(V.table(spark, d, "orders"), "o_custkey", "o_orderkey", ["o_orderkey"]).select("o_custkey", F.col("first.o_orderkey").alias("first_key"), F.col("second.o_orderkey").alias("second_key"))


@query("latest_of_kind", "SELECT o_custkey, o_orderstatus, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1, 2")
def latest_of_kind(spark, d):
    return S.latest_of(V.table(spark, d, "orders"), "o_custkey", "o_orderstatus", "o_orderkey", ["o_totalprice"])


@query("ordered_distinct", "SELECT o_custkey, string_agg(o_orderpriority, ',' ORDER BY first) AS priorities FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS first FROM orders GROUP BY 1, 2) GROUP BY 1")
def ordered_distinct(spark, d):
    return S.first_of_each(V.table(spark, d, "orders"), "o_custkey", "o_orderpriority", "o_orderkey").select("o_custkey", F.array_join("values", ",").alias("priorities"))


@query("usage_totals", "SELECT role, CAST(sum(length(text)) AS BIGINT) AS total_chars, CAST(sum(turn) AS BIGINT) AS total_turn FROM conversations GROUP BY 1")
def usage_totals(spark, d):
    return S.usage(V.table(spark, d, "conversations").withColumn("chars", F.length("text").cast("bigint")), ["role"], ["chars", "turn"])


@query("capabilities_cover", "SELECT task_id, list_contains(given, 's1') AND list_contains(given, 's2') AS both, CAST(n + n * (n - 1) / 2 + n * (n - 1) * (n - 2) / 6 AS BIGINT) AS programs FROM (SELECT *, len(given) AS n FROM (SELECT task_id, coalesce(given, []) AS given FROM parts_of))")
def capabilities_cover(spark, d):
    return evidence(spark, d).select("task_id", S.covers(F.array(F.lit("s1"), F.lit("s2")), F.col("given")).alias("both"), S.combinations_up_to(F.size("given"), 3).alias("programs"))


@query("standardized", "SELECT p_partkey, round((p_size - m) / s, 6) AS p_size FROM part, (SELECT avg(p_size) AS m, stddev_samp(p_size) AS s FROM part)")
def standardized(spark, d):
    return S.standardized(V.table(spark, d, "part").select("p_partkey", "p_size"), ["p_size"]).withColumn("p_size", F.round("p_size", 6))


@query("numeric_summary", "SELECT p_brand, unnest(['price', 'size']) AS key, unnest([min(p_retailprice), min(p_size)::DOUBLE]) AS least, unnest([median(p_retailprice), median(p_size)::DOUBLE]) AS median, unnest([max(p_retailprice), max(p_size)::DOUBLE]) AS greatest FROM part GROUP BY p_brand")
def numeric_summary(spark, d):
    p = V.table(spark, d, "part")
    return audit.numeric_summary(p.select("p_brand", F.create_map(F.lit("price"), F.col("p_retailprice"), F.lit("size"), F.col("p_size").cast("double")).alias("numbers")), "p_brand", "numbers")


@query("identity_join", "SELECT o_orderkey, 'missing' AS problem FROM orders WHERE o_orderkey % 17 = 0 UNION ALL SELECT o_orderkey, 'several' FROM orders WHERE o_orderkey % 17 = 1")
def identity_join(spark, d):
    """Contract records without a candidate (every 17th is left out on purpose) or with two."""
    o = V.table(spark, d, "orders").select("o_orderkey", K.identity("o_custkey", "o_orderkey", "o_orderstatus").alias("identity"))
    candidates = o.where("o_orderkey % 17 <> 0").unionByName(o.where("o_orderkey % 17 = 1"))
    return selection.identity_problems(candidates, o, "identity").join(o, "identity").select("o_orderkey", "problem")


@query("diversity_subset", "SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) > 20 AS later FROM orders) ORDER BY later, o_orderkey LIMIT 150")
def diversity_subset(spark, d):
    """The first 20 orders of each priority, then others up to 150: the limits are the feature."""
    return selection.diversity_subset(V.table(spark, d, "orders"), "o_orderpriority", ["o_orderkey"], 20, 150).select("o_orderkey")


@query("forbidden_tokens", "SELECT conv_id, turn, n, token FROM (SELECT conv_id, turn, n, unnest(regexp_extract_all(line, '[0-9]{2,}|@|the')) AS token FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM conversations))")
def forbidden_tokens(spark, d):
    lines = V.table(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("path"), F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("n", (F.col("n") + 1).cast("bigint"))
    return audit.forbidden_tokens(lines, "[0-9]{2,}|@|the").select("path.conv_id", "path.turn", "n", "token")


@query("backing_rows", "SELECT e.o_orderkey, b.o_orderstatus AS static_status FROM orders e LEFT JOIN orders b ON b.o_orderkey = CASE WHEN e.o_orderkey % 2 = 0 THEN e.o_orderkey + 1 ELSE e.o_orderkey END WHERE e.o_orderstatus IN ('F', 'O') AND e.o_orderpriority IN ('1-URGENT')")
def backing_rows(spark, d):
    """Finished and open urgent orders with the row that they rest on: even ones on the next, odd ones on their own."""
    o = V.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    wanted = S.only(o, o_orderstatus=["F", "O"], o_orderpriority=["1-URGENT"]).withColumn("backing", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") + 1))
    return S.with_backing(wanted, o, "o_orderkey", "backing").select("o_orderkey", F.col("static_o_orderstatus").alias("static_status"))


@query("prompted_commitment", """SELECT stream_id, CASE WHEN action = 'abstain' THEN 'abstain' WHEN far AND prompted THEN 're_clarify' ELSE 'answer' END AS action,
    CASE WHEN action = 'abstain' THEN reason WHEN far AND prompted THEN 'timestamp_too_imprecise' WHEN exact_match_found THEN 'exact_timestamp' ELSE 'nearest_but_acceptable' END AS reason
    FROM (SELECT *, NOT exact_match_found AND offset_seconds > 30 AS far, right(stream_id, 1) IN ('0', '2', '4', '6', '8') AS prompted FROM committed)""")
def prompted_commitment(spark, d):
    prompt = F.when(F.col("stream_id").rlike("[02468]$"), "or ask for a more precise timestamp").otherwise("answer")
    rows = committed(spark, d)
    return rows.select("stream_id", D.prompted_commitment(F.col("action"), F.col("reason"), F.col("exact_match_found"), F.col("offset_seconds"), prompt).alias("c")).select("stream_id", "c.action", "c.reason")


@query("time_anchor", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderdate WHEN 1 THEN o_orderdate + INTERVAL 1 DAY ELSE TIMESTAMP '2020-01-01' END AS anchor FROM orders")
def time_anchor(spark, d):
    k, at, none = F.col("o_orderkey"), F.col("o_orderdate"), F.lit(None).cast("timestamp_ntz")
    first = F.lit("2020-01-01").cast("timestamp_ntz")
    anchor = X.time_anchor(F.when(k % 3 == 0, at), none, F.when(k % 3 == 1, at + F.make_dt_interval(F.lit(1))), none, first)
    return V.table(spark, d, "orders").select("o_orderkey", anchor.alias("anchor"))
