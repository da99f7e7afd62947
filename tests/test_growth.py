"""What must not grow faster than the input, and what larger copies of the tables change."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidegauge.functions import columns as K
from tidegauge.functions import typed as J
from tidegauge.operators import aggregates as A
from tidegauge.operators import candidates as C
from tidegauge.operators import episodes, planning, text_checks, tools
from tidegauge.plans import QUERIES, SQL
from tidegauge.plans.views import table

SCHEMAS = {"points": "site_id string, stream_id string, point_class string, equipment_label string, location_label string", "asks": "request_id long, site_id string, point_class string, equipment_label string, location_label string"}


def test_equal_tasks_are_solved_once(spark):
    inventory = spark.createDataFrame([("S", f"p{i}", "Zone_Air_Temperature_Sensor", "p", "AHU", "Unit 1", "Room", "R 1") for i in range(3)], "site_id string, stream_id string, point_class string, point_label string, equipment_type string, equipment_label string, location_type string, location_label string")
    text = "Which zone air temperature sensor had the highest mean in January 1995?"
    tasks = spark.createDataFrame([(f"t{i}", "S", "window_rank", text) for i in range(5)] + [("other", "S", "window_rank", None)], "task_id string, site_id string, family string, text string")
    asked = []

    def list_points(rows):
        asked.append(rows.count())
        return rows.select("request_id", F.lit('{"stream_ids":["p0"]}').alias("output"))

    def rank_window(rows):
        asked.append(rows.count())
        return rows.select("request_id", J.object_of(J.written(ranked_streams=F.array(F.struct(F.lit("p0").alias("stream_id"), F.lit(1.5).alias("mean_value"))))).alias("output"))

    got = {r["task_id"]: r["answer"] for r in planning.solve(tasks, inventory, {"list_points": list_points, "rank_window": rank_window}).collect()}
    assert asked == [1, 1]
    assert got.pop("other") is None
    assert got == {f"t{i}": {"stream_id": '"p0"', "mean_value": "1.5"} for i in range(5)}


def test_answers_in_words_name_customers_as_their_table_does(spark, small, duck, tmp_path):
    for name in ("orders", "customer"):
        rows = table(spark, small, name)
        if name == "customer":
            # Copies with shifted keys keep their names; some have none.
            rows = rows.withColumn("c_name", F.when(F.col("c_custkey") % 7 > 0, F.concat(F.lit("Customer#"), F.lpad((F.col("c_custkey") % 5).cast("string"), 9, "0"))))
        else:
            # A total of the digits of its customer's number.
            rows = rows.withColumn("o_totalprice", F.when(F.col("o_custkey") > 9, F.col("o_custkey").cast("double")).otherwise(F.col("o_totalprice")))
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    got = {tuple(r) for r in QUERIES["answers_in_words"](spark, str(tmp_path)).select("task_id", "score", "issues").collect()}
    want = {(a, float(b), c) for a, b, c in duck.sql(f"SELECT task_id, score, issues FROM ({SQL['answers_in_words']})").fetchall()}
    assert got == want


def test_answers_are_judged_in_one_pass(spark):
    tasks = spark.range(7).select(F.col("id").alias("task_id"), F.lit("window_rank").alias("family"), J.written(stream_id=F.lit("p"), mean_value=F.lit(1.25)).alias("gold"), F.array(F.lit("value")).alias("required"))
    answers = spark.createDataFrame([(0, "P with 1.25"), (1, "Pump 1, 1.3"), (2, "1.2500"), (3, None)], "task_id long, text string")
    inventory = spark.createDataFrame([("p", "Pump 1", None, None)], "stream_id string, point_label string, equipment_label string, location_label string")
    found = text_checks.check(tasks, answers, inventory)
    lost = {r["task_id"]: [x.partition(":")[2] for x in r["issues"]] for r in found.collect()}
    both = ["winning_stream", "mean_value"]
    assert lost == {0: [], 1: ["mean_value"], 2: ["winning_stream"]} | {k: both for k in range(3, 7)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # Tasks are read once, whatever they have to tell, and nothing of their size is broadcast for its files being small.
    assert plan.count("Range (0, 7") == 1 and found._jdf.queryExecution().sparkPlan().toString().count("SortMergeJoin") == 2


def test_labels_are_met_by_equality(spark):
    points = [("S", "a", "Temp", "S Unit 1", "Hall"), ("S", "b", "Temp", "s unit 1", None), ("S", "c", "Temp", None, "Hall"), ("S", "d", "Temp", None, None), ("S", "e", "Flow", "`S  Unit 1`", "Hall"), ("S", "f", None, "S Unit 1", "Hall"), ("T", "g", "Temp", "S Unit 1", "Hall")]
    labels = (None, "S UNIT 1", "Unit 1", "hall", "Hall")
    asks = [(0, s, c, e, p) for s in ("S", "T", None) for c in ("Temp", "Any", "Flow", None) for e in labels for p in labels]
    asks = [(i, *a[1:]) for i, a in enumerate(asks + asks[:9])]
    alias = [("Any", "Temp"), ("Any", "Flow")]
    low = lambda x, _: x.lower()

    def loose(x, site):
        x = x.translate(str.maketrans("", "", "'\"`")).strip().lower()
        return " ".join((x[len(site) + 1 :] if x.startswith(site.lower() + " ") else x).split())

    def met(ask, classes, how):
        _, site, _, *wanted = ask
        return sorted(p[1] for p in points if p[0] == site and p[2] in classes and all(w is None or (o is not None and how(w, site) == how(o, site)) for w, o in zip(wanted, p[3:], strict=True)))

    want = {}
    for a in asks:
        first = met(a, {a[2]} - {None}, low)
        ids = first or met(a, ({a[2]} | {c for k, c in alias if k == a[2]}) - {None}, loose)
        want[a[0]] = (len(ids), ids or None, ids[0] if len(ids) == 1 else None, "fallback" if ids and not first else None)
    found = tools.resolve_points(spark.createDataFrame(points, SCHEMAS["points"]), spark.createDataFrame(asks, SCHEMAS["asks"]), spark.createDataFrame(alias, "alias string, point_class string"))
    assert {r[0]: tuple(r)[1:] for r in found.select("request_id", "match_count", "stream_ids", "stream_id", "resolution_strategy").collect()} == want
    # Labels are keys of the joins: no row is made only to be thrown away for its label.
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line]
    assert joins and not any("lower(" in j or "regexp_replace(" in j for j in joins)


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString()


def test_weeks_are_counted_once(spark):
    at = lambda *a: dt.datetime(2024, 1, *a)
    obs = spark.createDataFrame([("S", "a", at(1), 1.0), ("S", "a", at(7, 23), None), ("S", "a", at(22), 2.0), ("S", "b", at(9), 1.0), ("S", "a", None, 1.0)], "site_id string, stream_id string, ts timestamp_ntz, value double")
    anchors = spark.createDataFrame([(1, "a", at(3)), (2, "a", at(8)), (3, "a", at(15)), (4, "a", at(29)), (5, "b", at(1)), (6, "b", at(31)), (7, "c", at(1)), (8, "a", None)], "request_id long, stream_id string, anchor_ts timestamp_ntz")
    found = episodes.week_around(obs, anchors)
    got = {r["request_id"]: (r["window_start"].day, r["window_end"].day, r["count"]) for r in found.collect()}
    assert got == {1: (1, 8, 2), 2: (1, 8, 2), 3: (22, 29, 1), 4: (22, 29, 1), 5: (8, 15, 1)}
    # Observations meet no anchor before they are counted: one row for each day of a window would be made by sequence().
    assert "sequence(" not in plan_of(found)


def test_number_texts_in_steps(spark):
    numbers = [0.0, -0.0, 1.0, -1.05, 0.125, 0.375, 2.5, 1234.56789, 99999999999.99995, 1e11, -3e15, 1e-9, None]
    rows = spark.createDataFrame([(x,) for x in numbers], "x double")
    for n in (4, 3, 2, 1):
        pairs = K.with_fixed(rows, "t", "x", n).select("t", K.fixed("x", n).alias("want")).collect()
        assert [p["t"] for p in pairs] == [p["want"] for p in pairs]


def test_numbers_are_met_without_a_lambda(spark, small):
    assert "lambdafunction" not in plan_of(QUERIES["number_variants_match"](spark, small))


def test_sums_before_the_shuffle_are_bounded(spark):
    rows = spark.range(600_000).select(F.lit("S").alias("site_id"), (F.col("id") % 300_000).cast("string").alias("stream_id"), F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz").alias("ts"), F.col("id").cast("double").alias("value"))
    inventory = rows.select("site_id", "stream_id").distinct()
    for found in (A.summarize(rows, "day"), A.inventory_summary(inventory, rows)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        # By keys to as many tasks as the rows ask for, before anything is summed up.
        assert ", 3), REPARTITION_BY_NUM" in plan
    assert A.summarize(rows, "day").agg(F.sum("count"), F.count("*")).first()[:] == (600_000, 300_000)


def test_median_steps_by_places(spark):
    steps = {"odd": [5, 1, 3], "even": [4, 1, 0, 2, 9], "one": [7], "none": [], "equal": [0, 0]}
    rows = []
    for k, gaps in steps.items():
        at = dt.datetime(2024, 1, 1)
        rows.append(("S", k, at, 1.0))
        for g in gaps:
            at += dt.timedelta(seconds=g)
            rows.append(("S", k, at, None if g == 9 else float(g)))
    found = A.quality(spark.createDataFrame(rows, "site_id string, stream_id string, ts timestamp_ntz, value double"))
    got = {r["stream_id"]: (r["median_step_seconds"], r["longest_gap_seconds"], r["duplicate_timestamp_fraction"]) for r in found.collect()}
    assert got == {"odd": (3.0, 5.0, 0.0), "even": (3.0, 9.0, 0.166667), "one": (7.0, 7.0, 0.0), "none": (None, None, 0.0), "equal": (None, 0.0, 0.666667)}
    # Neither a buffer of a group's steps nor further shuffles for its distinct instants.
    assert "percentile(" not in plan_of(found) and "distinct" not in plan_of(found)


def test_quality_of_weeks_is_computed_once(spark, small):
    assert "lag(" not in QUERIES["quality_preference"](spark, small)._jdf.queryExecution().optimizedPlan().toString()


def steady(spark, streams, windows, days):
    """(points, aggregates, quality): so many streams of one site, each with so many full windows of equal means."""
    name = F.format_string("p%03d", F.col("id"))
    points = spark.range(streams).select(F.lit("S").alias("site_id"), name.alias("stream_id"), F.lit("Air_Temperature_Sensor").alias("point_class"), name.alias("equipment_label"), F.lit("R").alias("location_label"), F.lit("Room").alias("location_type"), F.lit(1).alias("candidate_ambiguity"))
    start = lambda k: F.timestamp_add("DAY", k * days, F.lit("2020-01-07").cast("timestamp_ntz"))
    rows = points.select("site_id", "stream_id").crossJoin(spark.range(windows))
    aggregates = rows.select("site_id", "stream_id", start(F.col("id")).alias("window_start"), start(F.col("id") + 1).alias("window_end"), F.lit(days).alias("count"), F.lit(1.0).alias("mean_value"))
    return points, aggregates, points.select("site_id", "stream_id", F.lit(86400.0).alias("median_step_seconds"))


def test_all_streams_have_their_first_windows(spark):
    parts = steady(spark, 40, 100, 7)
    got = {(r["stream_id"], r["window_start"], r["site_rank"]) for r in C.mean_lookup(*parts).collect()}
    assert got == {(f"p{i:03}", dt.datetime(2020, 1, 7), 100 * i + 1) for i in range(40)}
    assert C.mean_lookup(*parts, per_site=3000).count() == 30
    parts = steady(spark, 20, 400, 1)
    for latest in (False, True):
        found = C.quarter_lookup(*parts, latest=latest)
        assert [r[:] for r in found.groupBy("stream_id").count().orderBy("stream_id").collect()] == [(f"p{i:03}", 4) for i in range(20)]
        # From 7 January 2020 to 9 February 2021.
        days = {r[0].date() for r in found.select("window_start").distinct().collect()}
        assert days == ({dt.date(2021, 2, 9), dt.date(2020, 6, 30), dt.date(2020, 9, 30), dt.date(2020, 12, 31)} if latest else {dt.date(2020, 1, 7), dt.date(2020, 4, 1), dt.date(2020, 7, 1), dt.date(2020, 10, 1)})


def test_all_weeks_are_judged(spark):
    points, weekly, quality = steady(spark, 70, 120, 7)
    k = F.datediff("window_start", F.lit("2020-01-07")) / 7
    metrics = weekly.select("site_id", "stream_id", "window_start", F.lit(7).alias("n_points"), F.when(k % 3 == 0, 0.1).otherwise(1.0).alias("observed_fraction"), F.lit(1.0).alias("longest_gap_seconds"), F.lit(1.0).alias("median_step_seconds"), F.lit(0.0).alias("duplicate_timestamp_fraction"), F.lit(0.0).alias("nan_fraction"))
    thresholds = spark.createDataFrame([(0.5, 0.9, 2.0, 3.0)], "abstain_observed_fraction_below double, answer_observed_fraction_at_least double, answer_gap_ratio_at_most double, abstain_gap_ratio_above double")
    found = C.quality_gate(points, weekly, quality, metrics, thresholds)
    assert {r[0]: r[1] for r in found.groupBy("decision").count().collect()} == {"abstain": 70 * 40, "answer": 70 * 80}
    places = [r[:] for r in found.orderBy("place").select("place", "decision").collect()]
    assert places == [(i + 1, "abstain" if i < 5600 and i % 2 == 0 else "answer") for i in range(8400)]
