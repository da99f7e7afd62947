"""Answers in words, with facts told and left out."""

from __future__ import annotations

import json

from tidegauge.operators import text_checks


def gold(**x):
    return {k: json.dumps(v) for k, v in x.items()}


CASES = [
    ("window_mean_lookup", gold(mean_value=12.3456), ["mean_value"], "The mean was  12.35 degrees.", []),
    ("window_mean_lookup", gold(mean_value=12.0), [], "It was 12", []),
    ("window_mean_lookup", gold(mean_value=12.3456), [], "about 13", ["mean_value"]),
    ("window_pairwise_compare", gold(winning_stream_id="p1", left_mean_value=3.0, right_mean_value=2.5), ["winning_stream_id"], "The a_1 FCU 7 was higher: 3.0 against 2.5", []),
    ("window_pairwise_compare", gold(winning_stream_id="p1", left_mean_value=3.0, right_mean_value=2.5), [], "P1: 3", ["comparative_cue", "right_mean_value"]),
    ("timestamp_nearest_lookup", gold(observed_timestamp="2024-01-05T06:07:00", value=5, fallback_reason="nearest_available_observation"), ["fallback_reason", "value"], "The closest reading, on January 05, 2024 06:07, was 5.00", []),
    ("timestamp_value_lookup", gold(observed_timestamp="2024-01-05T06:07:00", value=5), ["stream_id"], "At 06:07 it was 6", ["value"]),
    ("quality_gate", gold(decision="abstain", reason="long_gap", observed_fraction=0.25), ["decision", "reason", "observed_fraction"], "I would abstain, as there is a big gap; only 0.25 is there.", []),
    ("quality_gate", gold(decision="answer", reason="low_coverage"), ["reason"], "I would abstain.", ["decision", "reason"]),
    ("reporting_commitment", gold(commitment_action="re_clarify", reason="timestamp_too_imprecise", clarification_request="narrower_time_range"), ["reason", "clarification_request"], "I need a narrower time range before reporting it", []),
    ("point_disambiguation", gold(stream_id="p1"), ["stream_id"], "Fan Coil Unit 7", ["stream_id"]),
    ("quality_trend_assessment", gold(trend_status="unheard"), [], "unheard", []),
    ("window_rank", gold(stream_id="p2", mean_value=1), ["sample_exact_match_found", "sample_checked_timestamp"], "p2 with 1", ["sample_exact_match_found"]),
    ("window_rank", gold(stream_id="p2", mean_value=1, sample_checked_timestamp="2024-01-05"), ["sample_checked_timestamp"], "Hall has 1 on 2024-01-05", []),
    ("quality_preference", gold(preferred_reference="second", decision="answer"), ["preferred_reference"], "I trust the second slightly more", []),
    ("quality_preference", gold(preferred_reference="first", window_start="2024-01-09T00:00:00", period="week"), [], "The one of January 09, 2024", []),
    ("quality_preference", gold(preferred_reference="first", window_start="2024-01-09", period="month"), [], "February 2024", ["preferred_reference"]),
    ("timestamp_preference", gold(preferred_reference="first", exact_match_found=True, observed_timestamp="2024-01-05T06:07:00", value=5), [], "the first, an exact match at 06:07 of 5", []),
    ("timestamp_preference", gold(preferred_reference="first", exact_match_found=False, observed_timestamp="2024-01-05T06:07:00", value=5), ["fallback_reason"], "the first, an exact match at 06:07 of 5", ["exact_cue"]),
    ("poem", gold(a=1), [], "roses", ["fallback"]),
    ("window_mean_lookup", gold(mean_value=1.5), [], None, ["mean_value"]),
]


def test_answers_in_words(spark):
    tasks = spark.createDataFrame([(k, f, g, r) for k, (f, g, r, *_) in enumerate(CASES)], "task_id int, family string, gold map<string,string>, required array<string>")
    answers = spark.createDataFrame([(k, c[3]) for k, c in enumerate(CASES) if c[3] is not None], "task_id int, text string")
    inventory = spark.createDataFrame([("p1", "A_1 Fan Coil Unit 7", "X_1 Fan Coil Unit 7", None), ("p2", None, None, "Hall"), ("p2", None, None, "Hall")], "stream_id string, point_label string, equipment_label string, location_label string")
    got = {r["task_id"]: r for r in text_checks.check(tasks, answers, inventory).collect()}
    for k, (*_, issues) in enumerate(CASES):
        assert got[k]["issues"] == [f"missing_answer_fact:{x}" for x in issues], CASES[k]
        assert got[k]["ok"] == (not issues)
    assert got[4]["score"] == 0.5
    only = {r["task_id"]: r["issues"] for r in text_checks.check(tasks, answers, inventory, core=False).collect()}
    at = {(c[0], c[3]): k for k, c in enumerate(CASES)}
    assert only[at["window_rank", "p2 with 1"]] == ["missing_answer_fact:sample_exact_match_found"] and only[at["window_rank", "Hall has 1 on 2024-01-05"]] == [] and only[2] == []


def test_evidence_followups(spark):
    basis = {"window_start": '"2024-01-09T00:00:00"', "period": '"week"', "equipment_label": '"X_1 Fan Coil Unit 7"'}
    cases = [
        # family, gold, phase golds, streams, basis, seen, text, ok
        ("window_mean_lookup", {}, [], ["p1"], {}, [], "From p1.", True), ("window_mean_lookup", {}, [], ["p1", "p2"], {}, [], "From p1.", False), ("window_mean_lookup", {}, [], ["p1", "p2"], {}, [], "Fan coil unit 7 and the hall", True),
        ("window_mean_lookup", {}, [], ["p1"], basis, [], "p1, week of January 09, 2024", True), ("window_mean_lookup", {}, [], ["p1"], basis, [], "p1, in March", False), ("window_mean_lookup", {}, [], ["p2"], basis, [], "hall, x_1 fcu 7", True),
        ("window_mean_lookup", {}, [], [], {}, [], "p1", False), ("window_mean_lookup", {}, [], ["p1"], {}, [], None, False),
        ("window_rank", gold(stream_id="p2"), [], ["p1", "p2", "p3"], {}, [], "The hall won", True), ("window_rank", gold(stream_id="p9"), [], ["p1", "p2", "p9"], {}, ["p1", "p2", "p1"], "p1 and p2", True),
        ("window_rank", gold(stream_id="p9"), [], ["p1", "p9"], {}, ["p1"], "p1 alone", False), ("window_rank", gold(stream_id="p9"), [], ["p1", "p9"], {}, [], "by ranking", True), ("window_rank", gold(stream_id="p9"), [], ["p1", "p9"], basis, [], "by ranking", False),
        ("window_pairwise_compare", {}, [gold(winning_stream_id="p1"), gold(winning_stream_id="p2")], ["p1", "p2"], {}, [], "the hall", True), ("window_pairwise_compare", {}, [gold(winning_stream_id="p2")], ["p1", "p2"], {}, [], "p1 alone", False),
        ("window_pairwise_compare", {}, [gold(winning_stream_id="p2")], ["p1", "p2"], {}, [], "p1 versus others", True),
    ]
    tasks = spark.createDataFrame([(k, *c[:6]) for k, c in enumerate(cases)], "task_id int, family string, gold map<string,string>, phase_golds array<map<string,string>>, streams array<string>, basis map<string,string>, seen array<string>")
    answers = spark.createDataFrame([(k, c[6]) for k, c in enumerate(cases)], "task_id int, text string")
    inventory = spark.createDataFrame([("p1", "A_1 Fan Coil Unit 7", None, None), ("p2", None, None, "Hall")], "stream_id string, point_label string, equipment_label string, location_label string")
    got = {r["task_id"]: r["ok"] for r in text_checks.evidence_followup(tasks, answers, inventory).collect()}
    assert [k for k, c in enumerate(cases) if got[k] != c[7]] == []


def test_rationale_followups(spark):
    low, far, both = gold(decision="abstain", observed_fraction=0.1, gap_ratio=1.0), gold(decision="abstain", observed_fraction=0.9, gap_ratio=50.0), gold(decision="abstain", observed_fraction=0.1, gap_ratio=50.0)
    fine = gold(decision="answer", observed_fraction=0.95, gap_ratio=1.0)
    cases = [
        ("quality_gate", low, [], [], "I would abstain for low coverage", True), ("quality_gate", low, [], [], "I would abstain: big gap", False), ("quality_gate", low, [], [], "I would abstain, data quality is bad", True), ("quality_gate", far, [], [], "abstain, as gaps reach 50.0", True),
        ("quality_gate", far, [], [], "abstain: coverage", False), ("quality_gate", both, [], [], "abstain: coverage", True), ("quality_gate", both, [], [], "abstain", False), ("quality_gate", fine, [], [], "I would answer; coverage is 0.95", True),
        ("quality_gate", fine, [], [], "I would answer, not that I would abstain; coverage", False), ("quality_gate", fine, [], [], None, False), ("quality_gate", fine, ["quality_gate", "quality_gate", "x"], [fine, low, fine], "I would abstain for coverage", True), ("other", fine, ["quality_gate"], [low], "I would answer: quality is healthy", True),
    ]
    tasks = spark.createDataFrame([(k, *c[:4]) for k, c in enumerate(cases)], "task_id int, family string, gold map<string,string>, phase_families array<string>, phase_golds array<map<string,string>>")
    answers = spark.createDataFrame([(k, c[4]) for k, c in enumerate(cases)], "task_id int, text string")
    reference = spark.createDataFrame([(0.5, 9.0)], "abstain_observed_fraction_below double, abstain_gap_ratio_above double")
    got = {r["task_id"]: r["ok"] for r in text_checks.rationale_followup(tasks, answers, reference).collect()}
    assert [k for k, c in enumerate(cases) if got[k] != c[5]] == []
