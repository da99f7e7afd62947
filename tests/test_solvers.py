"""Capabilities, rollouts, plans from text, preflight and repairs on small cases computed by hand."""

from __future__ import annotations

import itertools
import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidegauge.functions import typed as J
from tidegauge.operators import capabilities as C
from tidegauge.operators import planning, preflight, repairs, rollouts, sequences
from tidegauge.operators import aggregates as A
from tidegauge.operators import thresholds as T


def frozen_map(**x):
    return {k: json.dumps(v, separators=(",", ":")) for k, v in x.items()}


# ---- capabilities


def test_blocking_against_all_programs(spark):
    names = list("abcdef")
    rng = random.Random(3)
    masks = [0, *(rng.randrange(1 << 6) for _ in range(25)), 63]
    tasks = spark.createDataFrame([(k, m) for k, m in enumerate(masks)], "task_id int, needs long")
    spec = [("none", 0, 6), ("few", 0, 2), ("no_a", 1, 6), ("no_bc", 6, 3)]
    classes = spark.createDataFrame(spec, "solver_class string, forbidden long, most int")
    # A class can do a task if any set of capabilities that it may use, small enough, holds all needs.
    programs = {c: [p for p in range(64) if not p & f and p.bit_count() <= most] for c, f, most in spec}
    got = {r["task_id"]: r["blocked"] for r in C.blocking(tasks, classes).collect()}
    assert got == {k: sorted(c for c, *_ in spec if not any(p & m == m for p in programs[c])) for k, m in enumerate(masks)}
    report = {r["solver_class"]: tuple(r)[1:] for r in C.class_report(tasks, classes, 6).collect()}
    assert report == {c: (len(programs[c]), len({m for m in masks if any(p & m == m for p in programs[c])}), sum(any(p & m == m for p in programs[c]) for m in masks)) for c, *_ in spec}
    pairs = sorted(tuple(r) for r in C.contained(tasks).collect())
    assert pairs == sorted((a, b) for a, b in itertools.permutations(set(masks), 2) if a & b == a)
    needs = {r["needs"]: r for r in C.needs_report(tasks, names, 2).collect()}
    for m in set(masks):
        others = set(masks) - {m}
        assert needs[m]["minimal"] == (not any(o & m == o for o in others)) and needs[m]["maximal"] == (not any(o & m == m for o in others))
        assert needs[m]["capabilities"] == [n for k, n in enumerate(names) if m >> k & 1] and needs[m]["task_ids"] == [k for k, x in enumerate(masks) if x == m][:2] and needs[m]["n"] == masks.count(m)


# ---- rollouts


def test_features(spark):
    calls = [("find", '{"match_count": 0, "stream_id": "A-1"}'), ("total", '{"count": 2, "rows": [{"v": 12.50, "t": "2024-01-02T03:04:00"}], "b": true}')]
    rows = [(1, "x", calls, '"The mean was 12.5 at 2024-01-02 03:04 for a 1"', None, ["Room", "mean"]), (2, "y", [], None, "a: json_parse_error", None), (3, "x", calls[:1], '{"mean": 1}', "", [])]
    df = spark.createDataFrame(rows, "task_id int, family string, calls array<struct<tool_name: string, output: string>>, answer string, error string, terms array<string>")
    got = {r["task_id"]: r.asDict() for r in rollouts.features(df, ["x", "y"], ["find", "total"]).collect()}
    a, b, c = got[1], got[2], got[3]
    assert (a["num_steps"], a["has_final_answer"], a["final_answer_is_text"], a["any_zero_match"], a["any_positive_aggregate_count"]) == (2, 1, 1, 1, 1)
    assert (a["family_x"], a["family_y"], a["tool_count_find"], a["last_tool_find"], a["last_tool_total"]) == (1, 0, 1, 0, 1)
    assert (a["answer_mentions_average"], a["answer_mentions_top"], a["answer_has_timestamp"], a["answer_has_digits"]) == (1, 0, 1, 1)
    assert a["descriptor_overlap"] == 0.5 and a["all_stream_overlap"] == 0.5 and a["last_stream_overlap"] == 0
    # 12.5 and 2 are told in 12.5000, 12.500, ... of which `12 5` and `2` stand in the words.
    assert 0 < a["last_number_overlap"] < 1 and 0 < a["last_timestamp_overlap"] < 1
    assert (b["num_steps"], b["has_final_answer"], b["parse_error_json"], b["parse_error_missing"], b["answer_len_tokens"], b["last_number_overlap"]) == (0, 0, 1, 0, 0, 0)
    assert (c["has_final_answer"], c["final_answer_is_text"], c["has_parse_error"], c["answer_len_tokens"]) == (1, 0, 0, 0)


def test_trained_model(spark):
    rng = random.Random(5)
    rows = []
    for k in range(400):
        a, b, noise = rng.random(), rng.random(), rng.random()
        rows.append((k, a, b, noise, float((a > 0.5) != (b > 0.5))))
    df = spark.createDataFrame(rows, "id int, a double, b double, noise double, good double")
    model = rollouts.train(df.where("id < 300"), ["a", "b", "noise"], "good", hidden=12, rounds=150)
    held = rollouts.predict(model, df.where("id >= 300")).collect()
    assert sum((r["probability"] > 0.5) == (r["good"] == 1) for r in held) >= 90 and all(0 <= r["probability"] <= 1 for r in held)


# ---- a small store


@pytest.fixture(scope="module")
def store(spark):
    points = [("S", f"p{k}", "Air_Temperature_Sensor" if k < 3 else "Max_Flow_Limit", f"P{k}", "AHU", f"Unit {k}", "Room", None) for k in range(4)]
    inventory = spark.createDataFrame(points, "site_id string, stream_id string, point_class string, point_label string, equipment_type string, equipment_label string, location_type string, location_label string")
    obs = [("S", f"p{k}", datetime(2024, 1, d, 6 * h), float(10 * k + d)) for k in range(4) for d in range(1, 20) for h in range(4) if (k, d) != (1, 3)]
    table = spark.createDataFrame(obs, "site_id string, stream_id string, ts timestamp_ntz, value double").cache()
    quality = A.quality(table).cache()
    reference = T.quality_reference(quality).cache()
    return sequences.Tools(inventory, table, A.summarize(table, "week").cache(), quality, spark.createDataFrame([("Temp", "Air_Temperature_Sensor")], "alias string, point_class string"), reference, reference.withColumn("period", F.lit("week")))


SPAN = {"window_start": "2024-01-02T00:00:00", "window_end": "2024-01-09T00:00:00", "period": "week", "metric": "mean_value"}


def test_sequences_on_the_tools(spark, store):
    calls = [
        (1, 1, None, "resolve_point", frozen_map(site_id="S", point_class="Air_Temperature_Sensor", equipment_label="unit 1")),
        (1, 2, None, "aggregate_window", frozen_map(stream_id="$c1.stream_id", **SPAN)),
        (1, 3, "cmp", "compare_window", frozen_map(left_stream_id="$c1.matches[0].stream_id", right_stream_id="p2", **SPAN)),
        (1, 4, None, "rank_window", frozen_map(stream_ids=["p0", "$cmp.winning_stream_id", "$5.00"], topk=2, **SPAN)),
        (1, 5, None, "lookup_observation", frozen_map(stream_id="$c4.ranked_streams[0].stream_id", timestamp="2024-01-03T07:00:00", mode="nearest")),
        (1, 6, None, "lookup_observation", frozen_map(stream_id="p1", timestamp="2024-01-04T06:00:00+00:00", mode="exact")),
        (1, 7, None, "inspect_quality", frozen_map(stream_id="p1")),
        (1, 8, None, "inspect_quality_window", frozen_map(stream_id="p1", **SPAN)),
        (2, 1, "x", "resolve_point", frozen_map(site_id="S", point_class="Temp")),
        (2, 2, None, "list_points", frozen_map(site_id="S", point_class="$x.matches[9].point_class")),
        (2, 3, None, "nothing", frozen_map(a="$x.match_count", b={"k": ["$x.match_count", "cost $5.00"]})),
        (2, 4, None, "lookup_observation", frozen_map(stream_id="gone", timestamp="2024-01-04T06:00:00", mode="nearest")),
    ]
    table = spark.createDataFrame(calls, "task_id int, position int, call_id string, tool_name string, arguments map<string,string>")
    run = store.all() | {"nothing": lambda asked: asked.select("request_id", J.object_of("arguments").alias("output"))}
    done = {(r["task_id"], r["position"]): json.loads(r["output"]) for r in sequences.execute(table, run, 8).collect() if r["output"]}
    assert done[1, 1]["match_count"] == 1 and done[1, 1]["stream_id"] == "p1" and done[1, 1]["matches"][0]["equipment_label"] == "Unit 1"
    mean = round(sum(10 + d for d in range(2, 9) if d != 3) / 6, 4)
    assert done[1, 2]["mean_value"] == mean and done[1, 2]["count"] == 24 and done[1, 2]["stream_id"] == "p1"
    assert done[1, 3] == {"metric": "mean_value", "left_stream_id": "p1", "right_stream_id": "p2", "left_value": mean, "right_value": 25.0, "winning_stream_id": "p2", "window_start": "2024-01-02T00:00:00", "window_end": "2024-01-09T00:00:00"}
    assert done[1, 4]["ranked_streams"] == [{"stream_id": "p2", "mean_value": 25.0}, {"stream_id": "p0", "mean_value": 5.0}]
    assert (done[1, 5]["observed_timestamp"], done[1, 5]["value"], done[1, 5]["offset_seconds"], done[1, 5]["exact_match_found"]) == ("2024-01-03T06:00:00", 23.0, 3600.0, False)
    assert (done[1, 6]["value"], done[1, 6]["exact_match_found"]) == (14.0, True) and "fallback_reason" not in done[1, 6]
    assert done[1, 7]["stream_id"] == "p1" and set(done[1, 7]["quality_reference"]) == {"abstain_observed_fraction_below", "answer_observed_fraction_at_least", "answer_gap_ratio_at_most", "abstain_gap_ratio_above"}
    assert 0 < done[1, 8]["observed_fraction"] < 1 and done[1, 8]["gap_ratio"] == 5.0
    assert done[2, 1]["match_count"] == 3 and "stream_id" not in done[2, 1] and done[2, 1]["resolution_strategy"] == "fallback"
    assert done[2, 2]["count"] == 4, "a class that is null filters nothing"
    assert done[2, 3] == {"a": 3, "b": {"k": [3, "cost $5.00"]}}
    assert done[2, 4] == {"stream_id": "gone", "requested_timestamp": "2024-01-04T06:00:00", "exact_match_found": False}


def test_sequences_without_calls(spark, store):
    none = spark.createDataFrame([], "task_id int, position int, call_id string, tool_name string, arguments map<string,string>")
    assert sequences.execute(none, store.all(), 3).count() == 0
    late = spark.createDataFrame([(1, 2, None, "list_points", frozen_map(site_id="$c1.site"))], none.schema)
    assert [(r["call_id"], json.loads(r["output"])["count"]) for r in sequences.execute(late, store.all(), 3).collect()] == [("c2", 0)]


# ---- from text to answers


def test_phrases_of_any_length_and_inside_longer_ones(spark):
    phrases = spark.createDataFrame([(None, "class", "air temperature", "short"), (None, "class", "zone air temperature cooling setpoint", "long"), ("S", "equipment", "unit 1", "u1"), ("T", "equipment", "unit 2", "u2"), ("S", "equipment", "unit 3", "u3")], "site_id string, kind string, phrase string, value string")
    tasks = spark.createDataFrame([(1, "S", "f", "Zone Air-Temperature cooling setpoint of unit 3 or unit 1, not unit 2?"), (2, "S", "f", "air temperature"), (3, "S", "f", None)], "task_id int, site_id string, family string, text string")
    got = {r["task_id"]: (r["class"], r["equipment"]) for r in planning.grounded(tasks, phrases).collect()}
    assert got == {1: (["long"], ["u3", "u1"]), 2: (["short"], [])}


def test_texts_to_answers(spark, store):
    week = "in the week of January 2, 2024"
    tasks = [
        (1, "window_mean_lookup", f"What was the average air temperature reading on Unit 2 {week}?"),
        (2, "window_pairwise_compare", f"Is the air temperature higher on Unit 0 or Unit 2 {week}? I mean the air temperature sensor."),
        (3, "window_rank", "Which air temperature sensor had the lowest mean in January 2024?"),
        (4, "timestamp_nearest_lookup", "What did the air temperature sensor of Unit 1 show at 07:00 UTC on January 5, 2024?"),
        (5, "timestamp_value_lookup", "What did the max flow limit of Unit 3 show at 06:00:00 UTC on January 5, 2024?"),
        (6, "quality_gate", f"Can I trust the air temperature sensor of Unit 0 {week}?"),
        (7, "window_mean_lookup", "What was the average air temperature reading on Unit 2?"),
        (8, "poem", "Roses are red."),
        (9, "window_pairwise_compare", f"Is the air temperature sensor higher on Unit 0 {week}?"),
    ]
    table = spark.createDataFrame([(k, "S", f, t) for k, f, t in tasks], "task_id int, site_id string, family string, text string")
    got = {r["task_id"]: r["answer"] for r in planning.solve(table, store.inventory, store.all()).collect()}
    assert got[1] == {"stream_id": '"p2"', "mean_value": "25", "count": "28"}
    assert got[2] == {"winning_stream_id": '"p2"', "left_value": "5", "right_value": "25"}
    assert got[3]["stream_id"] == '"p0"'
    assert got[4] == {"stream_id": '"p1"', "value": "15", "observed_timestamp": '"2024-01-05T06:00:00"', "exact_match_found": "false"}
    assert got[5] == {"stream_id": '"p3"', "value": "35", "observed_timestamp": '"2024-01-05T06:00:00"', "exact_match_found": "true"}
    assert got[6]["decision"] in ('"answer"', '"abstain"') and got[6]["stream_id"] == '"p0"'
    assert got[7] is None and got[8] is None and got[9] is None


# ---- preflight

PHASE = "struct<family: string, gold: map<string,string>, required: array<string>>"


def test_preflight_rules(spark, store):
    mean = ("window_mean_lookup", frozen_map(stream_id="p2", mean_value=25, **SPAN), ["mean_value"])
    wrong = ("window_mean_lookup", frozen_map(stream_id="p2", mean_value=25.5, **SPAN), ["mean_value"])
    lacking = ("window_mean_lookup", frozen_map(mean_value=1, **SPAN), ["mean_value", "unit"])
    pair = ("window_pairwise_compare", frozen_map(left_stream_id="p0", right_stream_id="p2", left_mean_value=5.0, right_mean_value=25, winning_stream_id="p0", **SPAN), ["winning_stream_id"])
    rank = ("window_rank", frozen_map(stream_ids=["p0", "p2"], stream_id="p2", mean_value=24, **SPAN), [])
    look = ("timestamp_nearest_lookup", frozen_map(stream_id="p1", requested_timestamp="2024-01-05T07:00:00", observed_timestamp="2024-01-05 06:00:00", value=15, exact_match_found=False, fallback_reason="nearest_available_observation"), ["value"])
    bad_look = ("timestamp_value_lookup", frozen_map(stream_id="p1", requested_timestamp="2024-01-05T06:00:00", observed_timestamp="2024-01-05T12:00:00", value=16, exact_match_found=False, fallback_reason="x"), ["value"])
    empty_look = ("timestamp_value_lookup", frozen_map(stream_id="p1"), ["stream_id"])
    gates = [("quality_gate", frozen_map(stream_id="p0", decision=d, reason=r, observed_fraction=o, gap_ratio=1.0, **SPAN), ["decision"]) for d, r, o in (("answer", "healthy", 1.0), ("answer", "healthy", 0.1), ("abstain", "long_gap", 1.0), ("abstain", "marginal_quality", 1.0))]
    cases = {
        "good": (([mean, look], 1, "m", look), []),
        "structure": (([mean], 2, "n", None), [(None, "phase_count_mismatch"), (None, "final_phase_mismatch"), (None, "interaction_mode_mismatch")]),
        "golds": (([wrong, lacking, pair, rank], 3, "m", rank), [(1, "gold_differs"), (2, "gold_field_missing"), (2, "gold_lacks_arguments"), (3, "gold_differs"), (4, "gold_differs"), (4, "phase_required_fields_empty")]),
        "look": (([bad_look, empty_look], 1, "m", empty_look), [(1, "timestamp_exact_match_mismatch"), (1, "timestamp_fallback_reason_mismatch"), (1, "timestamp_observed_timestamp_mismatch"), (1, "timestamp_value_mismatch"), (2, "timestamp_phase_missing_gold_fields")]),
        "gates": ((gates, 3, "m", gates[3]), [(2, "quality_answer_threshold_mismatch"), (3, "quality_abstain_threshold_mismatch")]),
        "none": (([], -1, "m", None), []),
    }
    tasks = spark.createDataFrame([(n, mode, k, phases, final) for n, ((phases, k, mode, final), _) in cases.items()], f"task_id string, mode string, n_revisions int, phases array<{PHASE}>, final {PHASE}")
    tools = store.all()
    # The thresholds of the rules, not those of this little store.
    limits = spark.createDataFrame([("week", 0.5, 0.9, 2.0, 9.0)], "period string, abstain_observed_fraction_below double, answer_observed_fraction_at_least double, answer_gap_ratio_at_most double, abstain_gap_ratio_above double")
    found = preflight.preflight(tasks, F.lit("m"), tools, limits).where("not (kind = 'gold_differs' and task_id = 'gates')").collect()
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    for n, (_, want) in cases.items():
        assert sorted(((r["phase"], r["kind"]) for r in found if r["task_id"] == n), key=key) == sorted(want, key=key), n
    differs = {(r["phase"], r["field"]): (r["gold"], r["found"]) for r in found if r["task_id"] == "golds" and r["kind"] == "gold_differs"}
    assert differs == {(1, "mean_value"): ("25.5", "25"), (3, "winning_stream_id"): ('"p0"', '"p2"'), (4, "mean_value"): ("24", "25")}


def test_prompts(spark):
    rows = spark.createDataFrame([(1, 2, "reporting_commitment", "Report it as-is, a narrower time range, or abstain?"), (2, 2, "reporting_commitment", "Report it as-is or abstain?"), (3, 1, "other", None), (4, 1, "combined_reporting_commitment", "Abstain?")], "task_id int, phase int, family string, prompt string")
    assert sorted((r["task_id"], r["kind"]) for r in preflight.prompts(rows).collect()) == [(2, "reporting_commitment_prompt_mismatch"), (4, "combined_reporting_commitment_prompt_mismatch")]


# ---- repairs


def test_rules_in_order_with_history(spark):
    rows = spark.createDataFrame([(1, "a", 1, {"x": "1"}), (2, "b", 5, None), (3, None, None, {})], "id int, t string, n int, m map<string,string>")
    rules = [
        repairs.Rule("bump", "repair", F.col("n") < 3, {"n": F.col("n") + 1, "t": F.concat("t", F.lit("!"))}),
        repairs.Rule("again", "repair", F.col("n") == 2, {"n": F.col("n") * 10}),
        repairs.Rule("same", "surface", F.col("id") <= 2, {"t": F.col("t"), "m": F.map_concat("m", F.create_map(F.lit("y"), F.col("n").cast("string")))}),
        repairs.Rule("look", "audit", F.lit(True)),
    ]
    out = repairs.repaired(rows, rules)
    assert out.columns == ["id", "t", "n", "m", "history"]
    got = {r["id"]: r for r in out.collect()}
    assert (got[1]["t"], got[1]["n"], got[1]["m"]) == ("a!", 20, {"x": "1", "y": "20"}) and (got[2]["t"], got[2]["n"], got[2]["m"]) == ("b", 5, None) and got[3]["n"] is None
    entries = {k: [(h["stage"], h["status"], h["changed"]) for h in r["history"]] for k, r in got.items()}
    assert entries[1] == [("bump", "applied", ["n", "t"]), ("again", "applied", ["n"]), ("same", "applied", ["m"]), ("look", "unchanged", [])]
    assert entries[2] == [("bump", "skipped", []), ("again", "skipped", []), ("same", "unchanged", []), ("look", "unchanged", [])]
    assert {(r["stage"], r["status"]): r["n"] for r in repairs.applied(out).collect()}["bump", "skipped"] == 2
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_goals_revised(spark):
    def call(i, tool, **a):
        return (i, tool, frozen_map(**a))

    mean = [call("c1", "resolve_point", site="S"), call("c2", "aggregate_window", stream_id="$c1.stream_id", window_start="a", window_end="b")]
    pair = [call("c1", "resolve_point", e="x"), call("c2", "resolve_point", e="y"), call("c3", "compare_window", left_stream_id="$c1.stream_id", right_stream_id="$c2.stream_id", window_start="a", window_end="b")]
    rank = [call("c1", "list_points", site="S"), call("c2", "rank_window", stream_ids="$c1.stream_ids", window_start="a", window_end="b")]
    direct = [call("c1", "aggregate_window", stream_id="p", window_start="a", window_end="b")]
    gold = frozen_map(stream_id="p", mean_value=1, window_start="a", window_end="b")
    variants = {1: [mean, direct], 2: [pair], 3: [rank], 4: [mean], 5: [mean]}
    rows = spark.createDataFrame([(k, gold, [gold], v[0], v, [], ["ask", "provide_stream_evidence"] if k != 3 else ["ask"], 4) for k, v in variants.items()], f"task_id int, gold map<string,string>, phase_golds array<map<string,string>>, calls {repairs.CALL}, variants array<{repairs.CALL}>, turns array<string>, milestones array<string>, max_turns int")
    kinds = {1: ("aggregate_window", {"mean_value": 2, "winning_stream_id": "no"}), 2: ("compare_window", {"winning_stream_id": "q", "left_mean_value": 3, "mean_value": 9}), 3: ("rank_window", {"stream_id": "r", "mean_value": 7}), 4: ("unknown", {})}
    revisions = spark.createDataFrame([(k, kind, "next", "And then?", '"c"', '"d"', frozen_map(**v)) for k, (kind, v) in kinds.items()], "task_id int, kind string, direction string, prompt string, window_start string, window_end string, values map<string,string>")
    got = {r["task_id"]: r for r in repairs.revise_goals(rows, revisions).collect()}
    window = {"window_start": '"c"', "window_end": '"d"'}
    a = got[1]
    assert a["gold"] == frozen_map(stream_id="p", mean_value=2) | window and a["phase_golds"] == [gold, a["gold"]] and a["turns"] == ["And then?"] and a["max_turns"] == 5
    assert tuple(a["calls"][2]) == ("c3", "aggregate_window", {"stream_id": '"$c1.stream_id"'} | window)
    assert [[c["call_id"] for c in v] for v in a["variants"]] == [["c1", "c2", "c3"], ["c1", "c2", "c3", "c4"], ["c1", "c2"]]
    assert a["variants"][1][2]["arguments"] == {"site": '"S"'} and a["variants"][1][3]["arguments"] == {"stream_id": '"$c3.stream_id"'} | window
    assert a["milestones"] == ["ask", "receive_goal_revision", "deliver_revised_operator_answer", "provide_stream_evidence"]
    b = got[2]
    assert b["gold"] == gold | frozen_map(winning_stream_id="q", left_mean_value=3) and [len(v) for v in b["variants"]] == [4, 6]
    assert b["variants"][1][5]["arguments"] == {"left_stream_id": '"$c4.stream_id"', "right_stream_id": '"$c5.stream_id"'} | window
    c = got[3]
    assert c["gold"] == frozen_map(stream_id="r", mean_value=7) | window and c["variants"][1][3]["arguments"]["stream_ids"] == '"$c3.stream_ids"' and c["milestones"] == ["ask", "receive_goal_revision", "deliver_revised_operator_answer"]
    for k in (4, 5):
        assert got[k]["gold"] == gold and len(got[k]["phase_golds"]) == 1 and got[k]["history"][0]["status"] == "skipped" and got[k]["turns"] == []
