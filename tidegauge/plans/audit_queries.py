"""Queries of the catalog, family, scoring and audit layers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidegauge.functions import columns as K
from tidegauge.operators import aggregates as A
from tidegauge.operators import audit, catalog, episodes, families, scoring, tools
from tidegauge.plans import views as V
from tidegauge.plans.registry import query

V.CTES["summary"] = """SELECT i.*, n_points, n_distinct, first_ts, last_ts, mean_value, std_value, min_value, max_value FROM inventory i JOIN (
  SELECT site_id, stream_id, count(value) AS n_points, count(DISTINCT value) AS n_distinct, min(ts) AS first_ts, max(ts) AS last_ts, CAST(sum(CAST(value AS DECIMAL(20, 6))) AS DOUBLE) / count(value) AS mean_value,
  coalesce(round(stddev_samp(value), 4), 0.0) AS std_value, min(value) AS min_value, max(value) AS max_value FROM obs_coarse GROUP BY 1, 2) USING (site_id, stream_id)"""


def summary(spark, d):
    return A.inventory_summary(V.inventory(spark, d), V.obs_coarse(spark, d))


@query(
    "graph_equipment_location",
    """SELECT 'sup_' || s_suppkey AS point_entity, 'nat_' || s_nationkey AS equipment_entity, 'reg_' || n_regionkey AS location_entity FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
)
def graph_equipment_location(spark, d):
    entities, relations = V.graph(spark, d)
    points = entities.where("entity_id like 'sup%'").select(F.col("entity_id").alias("point_entity"))
    return catalog.stream_targets(points, relations).select("point_entity", "equipment_entity", "location_entity")


V.CTES["aliased"] = """SELECT entity_id, entity_label, primary_type, row_number() OVER (PARTITION BY primary_type ORDER BY entity_id) AS type_rank, primary_type || '_' || row_number() OVER (PARTITION BY primary_type ORDER BY entity_id) AS entity_alias
  FROM (SELECT 'sup_' || s_suppkey AS entity_id, s_name AS entity_label, 'Supplier_Sensor' AS primary_type FROM supplier UNION ALL SELECT 'nat_' || n_nationkey, n_name, 'Nation' FROM nation UNION ALL SELECT 'reg_' || r_regionkey, r_name, 'Region' FROM region)"""


@query("entity_alias", "SELECT * FROM aliased")
def entity_alias(spark, d):
    return catalog.entity_aliases(V.graph(spark, d)[0])


@query(
    "target_aliases",
    """SELECT 'sup_' || s_suppkey AS point_entity, 'nat_' || s_nationkey AS equipment_entity, 'reg_' || n_regionkey AS location_entity, a.entity_alias AS point_alias, b.entity_alias AS equipment_alias, c.entity_alias AS location_alias
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN aliased a ON a.entity_id = 'sup_' || s_suppkey JOIN aliased b ON b.entity_id = 'nat_' || s_nationkey JOIN aliased c ON c.entity_id = 'reg_' || n_regionkey""",
)
def target_aliases(spark, d):
    entities, _ = V.graph(spark, d)
    return catalog.with_aliases(graph_equipment_location(spark, d), catalog.entity_aliases(entities))


@query("unique_points_semi", "SELECT site_id, stream_id FROM inventory WHERE (site_id, point_class, equipment_label) IN (SELECT (site_id, point_class, equipment_label) FROM inventory GROUP BY ALL HAVING count(DISTINCT stream_id) = 1)")
def unique_points_semi(spark, d):
    return families.unique_points(V.inventory(spark, d), ["site_id", "point_class", "equipment_label"]).select("site_id", "stream_id")


@query("missing_points_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def missing_points_anti(spark, d):
    done = V.table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("stream_id"))
    return families.metadata_only(V.table(spark, d, "customer").select(F.col("c_custkey").alias("stream_id")), done).withColumnRenamed("stream_id", "c_custkey")


NUMBERED = "SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY point_class, stream_id) - 1 AS ordinal FROM summary"
SPLIT = "CASE WHEN ordinal % 5 = 4 THEN 'dev' WHEN ordinal % 5 = 3 THEN 'test' ELSE 'train' END"


@query("point_mean", f"SELECT site_id, stream_id, ordinal, {SPLIT} AS split, mean_value FROM ({NUMBERED})")
def point_mean(spark, d):
    return families.numbered(summary(spark, d), ["point_class", "stream_id"]).select("site_id", "stream_id", "ordinal", "split", "mean_value")


@query("point_extrema", f"SELECT site_id, stream_id, {SPLIT} AS split, CASE WHEN ordinal % 2 = 0 THEN 'min_value' ELSE 'max_value' END AS metric, CASE WHEN ordinal % 2 = 0 THEN min_value ELSE max_value END AS value FROM ({NUMBERED})")
def point_extrema(spark, d):
    return families.point_extrema(summary(spark, d), ["point_class", "stream_id"])


@query("coverage_lookup", f"SELECT site_id, stream_id, {SPLIT} AS split, n_points, first_ts, last_ts FROM ({NUMBERED}) WHERE n_points >= 2")
def coverage_lookup(spark, d):
    return families.numbered(summary(spark, d), ["point_class", "stream_id"]).where("n_points >= 2").select("site_id", "stream_id", "split", "n_points", "first_ts", "last_ts")


def led_sql(metric: str, margin: float) -> str:
    return f"""SELECT * EXCLUDE (k) FROM (SELECT site_id, location_label, stream_id AS top_stream_id, {metric} AS top_value, lead(stream_id) OVER w AS runner_stream_id, lead({metric}) OVER w AS runner_value, row_number() OVER w AS k
      FROM summary WINDOW w AS (PARTITION BY site_id, location_label ORDER BY {metric} DESC, stream_id)) WHERE k = 1 AND top_value - runner_value >= {margin}"""


@query("rank_by_mean_margin", led_sql("mean_value", 0.25))
def rank_by_mean_margin(spark, d):
    return families.leaders(summary(spark, d), ["site_id", "location_label"], "mean_value", 0.25)


@query("variability_rank", led_sql("std_value", 0.1))
def variability_rank(spark, d):
    return families.leaders(summary(spark, d), ["site_id", "location_label"], "std_value", 0.1)


@query(
    "pairwise_mean_margin",
    """SELECT *, CASE WHEN left_value > right_value THEN left_stream_id ELSE right_stream_id END AS winner FROM (SELECT site_id, point_class, stream_id AS left_stream_id, mean_value AS left_value, lead(stream_id) OVER w AS right_stream_id, lead(mean_value) OVER w AS right_value
    FROM summary WINDOW w AS (PARTITION BY site_id, point_class ORDER BY stream_id)) WHERE abs(left_value - right_value) >= 0.25""",
)
def pairwise_mean_margin(spark, d):
    return families.neighbours(summary(spark, d), ["site_id", "point_class"], "mean_value", 0.25)


@query("disambiguation_catalog", f"SELECT site_id, stream_id, point_class, equipment_label, location_label FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY point_class, stream_id) AS k FROM summary) WHERE k % 3 = 1 AND k <= 150")
def disambiguation_catalog(spark, d):
    return families.every_nth(summary(spark, d), ["point_class", "stream_id"], 3, 50).select("site_id", "stream_id", "point_class", "equipment_label", "location_label")


# ---- scoring: gold is an order's own total, priority and date; the prediction is that of the customer's order before it


V.CTES["scored"] = """SELECT o_orderkey AS task_id, o_totalprice AS gold_total, lag(o_totalprice) OVER w AS pred_total, o_orderpriority AS gold_priority, CASE WHEN o_orderkey % 2 = 0 THEN lower(lag(o_orderpriority) OVER w) ELSE lag(o_orderpriority) OVER w END AS pred_priority,
  o_orderstatus AS gold_status, lag(o_orderstatus) OVER w AS pred_status FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)"""
GOOD = "[coalesce(abs(gold_total - pred_total) <= 50000, false), coalesce(gold_priority = pred_priority, false), coalesce(gold_status = pred_status, false)]"


def scored(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = V.table(spark, d, "orders")
    rows = o.select(
        F.col("o_orderkey").alias("task_id"), F.col("o_totalprice").alias("gold_total"), F.lag("o_totalprice").over(w).alias("pred_total"), F.col("o_orderpriority").alias("gold_priority"),
        F.when(F.col("o_orderkey") % 2 == 0, F.lower(F.lag("o_orderpriority").over(w))).otherwise(F.lag("o_orderpriority").over(w)).alias("pred_priority"), F.col("o_orderstatus").alias("gold_status"), F.lag("o_orderstatus").over(w).alias("pred_status"),
    )
    return scoring.structured(rows, {"total": 50_000.0, "priority": None, "status": None})


@query(
    "score_structured",
    f"""SELECT task_id, 3 AS n_checks, (pred_total IS NULL)::INT + (pred_priority IS NULL)::INT + (pred_status IS NULL)::INT AS n_missing, len(list_filter(g, lambda x: x)) / 3.0::DOUBLE AS score, len(list_filter(g, lambda x: x)) = 3 AS ok,
    concat_ws(',', CASE WHEN NOT g[1] THEN CASE WHEN pred_total IS NULL THEN 'missing_total' ELSE 'wrong_total' END END, CASE WHEN NOT g[2] THEN CASE WHEN pred_priority IS NULL THEN 'missing_priority' ELSE 'wrong_priority' END END,
    CASE WHEN NOT g[3] THEN CASE WHEN pred_status IS NULL THEN 'missing_status' ELSE 'wrong_status' END END) AS issues FROM (SELECT *, {GOOD} AS g FROM scored)""",
)
def score_structured(spark, d):
    return scored(spark, d).select("task_id", "n_checks", "n_missing", "score", "ok", "issues")


V.CTES["parts_of"] = "SELECT l_orderkey AS task_id, list('s' || l_suppkey) AS required, list_sort(list(DISTINCT 's' || l_suppkey) FILTER (l_returnflag <> 'R')) AS given, list('t' || l_linenumber % 3 ORDER BY l_linenumber, l_partkey) AS tools FROM lineitem GROUP BY 1"


def evidence(spark, d):
    l = V.table(spark, d, "lineitem")
    name = F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    tool = F.concat(F.lit("t"), (F.col("l_linenumber") % 3).cast("string"))
    order = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", tool.alias("tool"))))
    return l.groupBy(F.col("l_orderkey").alias("task_id")).agg(F.collect_list(name).alias("required"), F.collect_set(F.when(F.col("l_returnflag") != "R", name)).alias("given"), F.transform(order, lambda x: x["tool"]).alias("tools"))


@query("score_evidence_recall", "SELECT task_id, len(list_filter(required, lambda x: list_contains(coalesce(given, []), x))) / len(required)::DOUBLE AS score, array_to_string(list_sort(list_filter(required, lambda x: NOT list_contains(coalesce(given, []), x))), ',') AS missing FROM parts_of")
def score_evidence_recall(spark, d):
    rows = evidence(spark, d)
    return rows.select("task_id", scoring.recall(F.col("required"), F.col("given")).alias("score"), F.array_join(F.array_sort(F.filter("required", lambda x: ~F.array_contains("given", x))), ",").alias("missing"))


@query(
    "score_process",
    """SELECT task_id, greatest(CASE WHEN list_contains(tools, 't1') AND list_contains(tools, 't2') THEN 1.0 WHEN list_contains(tools, 't1') OR list_contains(tools, 't2') THEN 0.5 ELSE 0.0 END,
    len(list_filter(range(3), lambda i: tools[i + 1] = ['t1', 't2', 't0'][i + 1])) / 3.0::DOUBLE, (tools[1] = 't1')::INT::DOUBLE) AS score FROM parts_of""",
)
def score_process(spark, d):
    variants = F.array(F.array(*map(F.lit, ("t1", "t2", "t0"))), F.array(F.lit("t1")))
    return evidence(spark, d).select("task_id", scoring.process(F.array(F.lit("t1"), F.lit("t2")), variants, F.col("tools")).alias("score"))


@query(
    "score_temporal",
    """SELECT task_id, sum(hit) / count(*)::DOUBLE AS score FROM (SELECT stream_id AS task_id, EXISTS (SELECT 1 FROM obs_fine o WHERE o.stream_id = w.stream_id AND date_trunc('day', o.ts) = w.window_start)::INT AS hit FROM fine_week w) GROUP BY 1""",
)
def score_temporal(spark, d):
    """Each stored week is required; calls ask for the days that have data, so that a week is met if its first day has some."""
    obs = V.obs_fine(spark, d)
    weekly = A.summarize(obs, "week").select(F.col("stream_id").alias("task_id"), F.lit("aggregate").alias("tool"), "window_start", (F.col("window_start") + F.make_dt_interval(F.lit(1))).alias("window_end"))
    calls = obs.select(F.col("stream_id").alias("task_id"), F.lit("aggregate").alias("tool"), K.day_of("ts").alias("window_start")).withColumn("window_end", F.col("window_start") + F.make_dt_interval(F.lit(1)))
    return scoring.temporal(weekly, calls)


@query(
    "score_task_label",
    f"""SELECT task_id, CASE WHEN NOT g[1] THEN 'wrong_answer' WHEN NOT g[2] THEN 'ungrounded' WHEN NOT g[3] THEN 'wrong_time' WHEN pred_total IS NULL THEN 'phases_missing' ELSE 'success' END AS label FROM (SELECT *, {GOOD} AS g FROM scored)""",
)
def score_task_label(spark, d):
    rows = scored(spark, d)
    total, same = K.within("gold_total", "pred_total", 50_000.0), lambda f: F.coalesce(F.col(f"gold_{f}") == F.col(f"pred_{f}"), F.lit(False))
    return rows.select("task_id", scoring.label(total, same("priority"), same("status"), F.col("pred_total").isNotNull()).alias("label"))


@query("number_variants_match", "SELECT l_orderkey, l_linenumber, l_partkey, contains(text, a) OR contains(text, b) OR contains(text, c) OR contains(text, e) OR contains(text, regexp_replace(a, '\\.?0+$', '')) AS found FROM (SELECT *, 'it was ' || printf('%.1f', l_extendedprice) || ' in all' AS text, printf('%.4f', l_extendedprice / 10) AS a, printf('%.3f', l_extendedprice / 10) AS b, printf('%.2f', l_extendedprice / 10) AS c, printf('%.1f', l_extendedprice / 10) AS e FROM lineitem)")
def number_variants_match(spark, d):
    l = V.table(spark, d, "lineitem")
    ways = [f"way{n}" for n in (4, 3, 2, 1)]
    rows = K.with_fixed(l.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", (F.col("l_extendedprice") / 10).alias("tenth")), "said", "l_extendedprice", 1)
    for w in ways:
        rows = K.with_fixed(rows, w, "tenth", int(w[-1]))
    text = F.concat(F.lit("it was "), F.col("said"), F.lit(" in all"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", scoring.mentions(text, [*map(F.col, ways), F.regexp_replace("way4", r"\.?0+$", "")]).alias("found"))


@query("stable_template_choice", "SELECT stream_id, CAST(('0x' || md5(stream_id)[1:8])::BIGINT % 5 AS BIGINT) AS template, 'pv_' || sha1(stream_id)[1:12] AS short_id FROM inventory")
def stable_template_choice(spark, d):
    return V.inventory(spark, d).select("stream_id", K.stable_choice("stream_id", 5).alias("template"), K.short_id("pv_", "stream_id").alias("short_id"))


# ---- audits


@query("collision_groups", "SELECT p_brand, p_type, p_size, count(*) AS n, count(DISTINCT p_retailprice) AS n_gold, string_agg(DISTINCT CAST(p_partkey AS VARCHAR), ';' ORDER BY CAST(p_partkey AS VARCHAR)) AS keys FROM part GROUP BY 1, 2, 3 HAVING count(*) > 1 AND count(DISTINCT p_retailprice) > 1")
def collision_groups(spark, d):
    return audit.collisions(V.table(spark, d, "part"), ["p_brand", "p_type", "p_size"], "p_retailprice", "p_partkey")


RULES = {"no_value": "value is null or value <= 0", "large_value": "value > 200", "late": "ts >= timestamp_ntz '2024-01-20'", "odd_type": "event_type not in ('click', 'view')"}


def event_problems(spark, d):
    return audit.problems(V.table(spark, d, "events"), "event_id", {k: F.expr(v) for k, v in RULES.items()})


PROBLEMS = " UNION ALL ".join(f"SELECT event_id, '{k}' AS kind FROM events WHERE {v.replace('timestamp_ntz', 'timestamp')}" for k, v in RULES.items())


@query("contract_preflight", PROBLEMS)
def contract_preflight(spark, d):
    return event_problems(spark, d)


@query("issue_histogram", f"SELECT kind, count(*) AS n FROM ({PROBLEMS}) GROUP BY 1")
def issue_histogram(spark, d):
    return audit.histogram(event_problems(spark, d), "kind")


@query("family_split_histogram", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping_id(o_orderstatus, o_orderpriority) AS level FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def family_split_histogram(spark, d):
    return audit.levels(V.table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


@query("first_blocking_layer", "SELECT kind, count(*) AS n FROM (SELECT CASE WHEN NOT o_totalprice < 300000 THEN 'price' WHEN NOT o_orderstatus <> 'P' THEN 'status' WHEN NOT o_orderpriority <> '1-URGENT' THEN 'priority' ELSE 'none' END AS kind FROM orders) GROUP BY 1")
def first_blocking_layer(spark, d):
    o = V.table(spark, d, "orders")
    layers = [("price", F.col("o_totalprice") < 300_000), ("status", F.col("o_orderstatus") != "P"), ("priority", F.col("o_orderpriority") != "1-URGENT")]
    return o.groupBy(audit.first_blocking(layers).alias("kind")).agg(F.count("*").alias("n"))


@query("union_distinct_except", "SELECT kind, count(*) AS n FROM (SELECT 'union' AS kind, k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT 'both', k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'only', k FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders)) GROUP BY 1")
def union_distinct_except(spark, d):
    c, s, o = (V.table(spark, d, t) for t in ("customer", "supplier", "orders"))
    a, b = c.select(F.col("c_nationkey").alias("k")), s.select(F.col("s_nationkey").alias("k"))
    parts = {"union": a.union(b).distinct(), "both": a.intersect(b), "only": c.select(F.col("c_custkey").alias("k")).subtract(o.select("o_custkey"))}
    return audit.union_all([df.select(F.col("k").cast("bigint").alias("k"), F.lit(kind).alias("kind")) for kind, df in parts.items()]).groupBy("kind").agg(F.count("*").alias("n"))


@query("store_equality", "SELECT count(*) AS n_stored, 0 AS n_different FROM fine_day")
def store_equality(spark, d):
    """The daily aggregates of two differently dealt copies of the observations."""
    obs = V.obs_fine(spark, d)
    a, b = A.summarize(obs, "day"), A.summarize(obs.repartition(7, "ts"), "day")
    n = a.agg(F.count("*").alias("n_stored"))
    return n.crossJoin(audit.difference(a, b).agg(F.count("*").alias("n_different")))


@query("trace_binding", "SELECT o_orderkey, 'no_task' AS problem FROM orders WHERE o_orderkey % 11 = 0 UNION ALL SELECT o_orderkey, 'differs_o_orderstatus' FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 13 = 0 AND o_orderstatus <> 'X'")
def trace_binding(spark, d):
    o = V.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    tasks = o.where("o_orderkey % 11 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 13 == 0, "X").otherwise(F.col("o_orderstatus")))
    return audit.binding(o, tasks, "o_orderkey", ["o_orderstatus", "o_orderpriority"])


@query("stream_lineage_list", "SELECT l_suppkey, string_agg(DISTINCT CAST(l_orderkey AS VARCHAR), ';' ORDER BY CAST(l_orderkey AS VARCHAR)) AS orders FROM lineitem GROUP BY 1")
def stream_lineage_list(spark, d):
    l = V.table(spark, d, "lineitem")
    return l.groupBy("l_suppkey").agg(F.concat_ws(";", F.array_sort(F.collect_set(F.col("l_orderkey").cast("string")))).alias("orders"))


# ---- dialogue

STATES = """SELECT conv_id, turn, role, CASE WHEN role = 'system' THEN 'setup' WHEN role = 'user' THEN CASE WHEN a > 0 THEN 'revision' WHEN u > 0 THEN 'clarify' ELSE 'request' END WHEN a > 0 THEN 'revised_answer' ELSE 'answer' END AS state, stops FROM (
  SELECT *, coalesce(sum((role = 'assistant')::INT) OVER b, 0) AS a, coalesce(sum((role = 'user')::INT) OVER b, 0) AS u, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL AS stops FROM conversations
  WINDOW b AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
V.CTES["states"] = STATES


@query("dialogue_state", "SELECT * FROM states")
def dialogue_state(spark, d):
    return episodes.dialogue_states(V.table(spark, d, "conversations"))


@query("interaction_mode", "SELECT conv_id, string_agg(state, '_then_' ORDER BY first) AS mode FROM (SELECT conv_id, state, min(turn) AS first FROM states WHERE state <> 'setup' GROUP BY 1, 2) GROUP BY 1")
def interaction_mode(spark, d):
    return episodes.interaction_modes(episodes.dialogue_states(V.table(spark, d, "conversations")))


@query("call_sequence_refs", "SELECT o_orderkey AS task_id, 'c2' AS call_id, 'cust_' || o_custkey AS stream_id, o_orderstatus AS metric FROM orders")
def call_sequence_refs(spark, d):
    """Two calls of each task; the second takes its stream from the first one's output."""
    o = V.table(spark, d, "orders")
    none = F.create_map().cast("map<string,string>")
    first = o.select(F.col("o_orderkey").alias("task_id"), F.lit("c1").alias("call_id"), F.lit("resolve").alias("tool_name"), none.alias("arguments"), F.create_map(F.lit("stream_id"), F.concat(F.lit("cust_"), F.col("o_custkey").cast("string"))).alias("output"))
    second = o.select(F.col("o_orderkey").alias("task_id"), F.lit("c2").alias("call_id"), F.lit("aggregate").alias("tool_name"), F.create_map(F.lit("stream_id"), F.lit("$c1.stream_id"), F.lit("metric"), F.col("o_orderstatus")).alias("arguments"), none.alias("output"))
    done = tools.resolve_references(first.unionByName(second)).where("call_id = 'c2'")
    return done.select("task_id", "call_id", F.col("arguments")["stream_id"].alias("stream_id"), F.col("arguments")["metric"].alias("metric"))


@query("week_around_anchor", """SELECT request_id, stream_id, window_start, count FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY place) AS k FROM (
    SELECT e.event_id AS request_id, 'usr_' || e.user_id AS stream_id, place, CAST(date_trunc('week', e.ts) AS TIMESTAMP) + days * INTERVAL 1 DAY AS window_start, count(*) AS count
    FROM events e, (SELECT unnest([0, 1, 2]) AS place, unnest([0, -7, 7]) AS days) p, obs_fine o WHERE o.stream_id = 'usr_' || e.user_id AND o.ts >= date_trunc('week', e.ts) + days * INTERVAL 1 DAY AND o.ts < date_trunc('week', e.ts) + (days + 7) * INTERVAL 1 DAY GROUP BY ALL)) WHERE k = 1""")
def week_around_anchor(spark, d):
    e = V.table(spark, d, "events")
    anchors = e.select(F.col("event_id").alias("request_id"), F.concat(F.lit("usr_"), F.col("user_id").cast("string")).alias("stream_id"), F.col("ts").alias("anchor_ts"))
    return episodes.week_around(V.obs_fine(spark, d), anchors).select(F.col("request_id").cast("bigint").alias("request_id"), "stream_id", "window_start", "count")
