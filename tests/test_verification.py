"""Scores by hand-computed cases, typed JSON, and verification from calls to labels."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidegauge.functions import typed as J
from tidegauge.functions.columns import same_instant
from tidegauge.operators import scoring
from tidegauge.operators import verification as W


def value(spark, column, **row):
    kinds = {str: "string", int: "int", float: "double", type(None): "string"}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in row.items())) if row else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def words(*x):
    return F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")


def test_sequences_and_recall(spark):
    assert value(spark, scoring.sequence_match(words("a", "b"), words("a", "b", "c", "d"))) == 1.0
    assert value(spark, scoring.sequence_match(words("a", "b", "c"), words("a", "x"))) == pytest.approx(1 / 3)
    assert value(spark, scoring.sequence_match(words(), words("a"))) == 1.0
    assert value(spark, scoring.sequence_match(words("a"), words())) == 0.0
    assert value(spark, scoring.recall(words("a", "a", "b"), words("a"))) == pytest.approx(2 / 3)
    assert value(spark, scoring.recall(words(), words())) == 1.0
    rows = spark.createDataFrame([("Healthy", "healthy", 1.0, 1.05), ("x", None, None, None)], "gold_a string, pred_a string, gold_b double, pred_b double")
    got = [(r["score"], r["issues"]) for r in scoring.structured(rows, {"a": None, "b": 0.1}).collect()]
    assert got == [(0.5, "wrong_a"), (0.0, "missing_a,missing_b")]


def test_relaxed_windows_of_several_streams(spark):
    at = lambda h, m=0: datetime(2024, 1, 1, h, m)
    obs = spark.createDataFrame([("A", at(0, 10), 1.0), ("A", at(9), 1.0), ("B", at(5), 1.0), ("B", at(8), 2.0)], "stream_id string, ts timestamp, value double")
    golds = spark.createDataFrame([(1, "A", at(0), at(8)), (1, "B", at(0), at(8)), (1, "B", at(4), at(8))], "task_id int, stream_id string, window_start timestamp, window_end timestamp")
    got = {(r["stream_id"], r["label"], r["window_start"], r["window_end"]) for r in scoring.relaxed_windows(obs, golds).collect()}
    assert ("A", "nearest_start_fixed_duration", at(0, 10), at(8, 10)) in got
    assert ("A", "nearest_start_nearest_end", at(0, 10), at(9)) in got
    assert ("B", "nearest_start_fixed_duration", at(5), at(13)) in got
    assert ("B", "nearest_start_fixed_duration", at(5), at(9)) in got
    assert ("B", "exact", at(4), at(8)) in got
    assert not [r for r in got if r[0] == "A" and r[2] == at(5)]


def test_typed_json(spark):
    assert value(spark, J.frozen("j"), j='{"b": 1.0, "a": {"z": [2.50, null]}}') == '{"a":{"z":[2.5,null]},"b":1}'
    assert value(spark, J.fields("j"), j='{"a": "x", "b": {"d": 1, "c": 2}}') == {"a": '"x"', "b": '{"c":2,"d":1}'}
    assert value(spark, J.fields("j"), j="[1]") is None
    assert value(spark, J.fields("j"), j="{bad") is None
    assert value(spark, J.texts_in("j"), j='{"k": "a\\"b:", "m": [{"n": "c"}, 3, "k"]}') == ['a"b:', "c", "k"]
    assert value(spark, J.items("j"), j='[1, "x", {"b":1,"a":2}]') == ["1", '"x"', '{"a":2,"b":1}']
    for a, b, equal in [("1e3", "1000", True), ('"1"', "1", False), ('"x"', '"X"', False), ('{"a":1,"b":2}', '{"b":2,"a":1}', True), ("null", "null", True)]:
        assert value(spark, J.same(J.frozen("a"), J.frozen("b")), a=a, b=b) is equal
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        for a, b in [("2024-01-01T00:00:00Z", "2024-01-01 00:00:00"), ("2024-01-01", "2024-01-01T01:00:00+01:00"), ("2024-06-01T00:00", "2024-06-01T00:00:00+00:00")]:
            assert value(spark, same_instant("a", "b"), a=a, b=b) is True
        assert value(spark, same_instant("a", "b"), a="x", b="x") is False
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def frozen_map(**x):
    import json

    return {k: json.dumps(v, separators=(",", ":")) for k, v in x.items()}


AT = ["2024-01-01T00:00:00", "2024-01-08T00:00:00"]
CALL = "struct<call_id: string, tool_name: string, arguments: map<string,string>>"
TASK = f"task_id int, family string, period string, gold map<string,string>, required array<string>, tolerance map<string,double>, streams array<string>, tools array<string>, variants array<array<{CALL}>>"


def asked(start=AT[0], end=AT[1], stream="A", period="week", **more):
    return frozen_map(stream_id=stream, window_start=start, window_end=end, period=period, **more)


def gold(family="window_mean_lookup", variants=None, required=("stream_id", "mean_value"), tools=("aggregate_window",)):
    variants = [[("c1", "aggregate_window", asked())]] if variants is None else variants
    return (family, "week", frozen_map(stream_id="A", mean_value=2.0, window_start=AT[0], window_end=AT[1]), list(required), {"mean_value": 0.1}, ["A", "A", "B"], list(tools), variants)


CASES = {
    # name: (task, calls, final, evidence) and label, process, core, evidence, temporal, issues
    "exact": ((gold(), [("aggregate_window", asked(), '{"stream_id":"A","mean_value":2.0}')], '{"mean_value": 2.05, "stream_id": "A"}', '{"stream_ids": ["A", "B"]}'), ("accomplished", 1, 1, 1, 1, [])),
    "moved": ((gold(), [("aggregate_window", asked("2024-01-01 06:00:00+00:00", "2024-01-08T06:00:00"), '{"stream_id":"A","mean_value":7.5}')], '{"mean_value": 7.5, "stream_id": "A"}', '["B", {"stream_id": "A"}]'), ("accomplished", 1, 1, 1, 1, [])),
    "moved, other family": (
        (gold("point_mean"), [("aggregate_window", asked("2024-01-01T06:00:00", "2024-01-08T06:00:00"), '{"mean_value":7.5}')], '{"mean_value": 7.5, "stream_id": "A"}', '{"stream_ids": ["A", "B"]}'),
        ("partially_accomplished", 1, 0.5, 1, 0, ["call_sequence_mismatch", "temporal_mismatch:aggregate_window:window_start,window_end,period", "numeric_mismatch:mean_value"]),
    ),
    "moved, other period": (
        (gold(), [("aggregate_window", asked("2024-01-01T06:00:00", "2024-01-08T06:00:00", period="day"), '{"mean_value":7.5}')], '{"mean_value": 2, "stream_id": "A"}', '{"stream_ids": ["A", "B"]}'),
        ("partially_accomplished", 1, 1, 1, 0, ["call_sequence_mismatch", "temporal_mismatch:aggregate_window:window_start,window_end,period"]),
    ),
    "outputs as evidence": ((gold(), [("aggregate_window", asked(), '{"stream_id":"A","rows":[{"id":"B"}],"mean_value":2}')], '{"mean_value": "2", "stream_id": "A"}', None), ("accomplished", 1, 1, 1, 1, [])),
    "half the evidence": ((gold(), [("aggregate_window", asked(limit=3), '{"mean_value":2}')], '{"mean_value": 2, "stream_id": "a"}', '{"stream_ids": "A"}'), ("partially_accomplished", 1, 0.5, 0.6667, 1, ["value_mismatch:stream_id", "missing_evidence:B"])),
    "nothing": ((gold(), [], None, None), ("partially_accomplished", 0, 0, 0, 0, ["missing_tool:aggregate_window", "call_sequence_mismatch", "temporal_mismatch:aggregate_window:window_start,window_end,period", "missing_answer_fact:final_answer", "missing_evidence:A", "missing_evidence:A", "missing_evidence:B"])),
    "best variant": (
        (gold("other", [[("x_sample", "lookup_observation", frozen_map(timestamp=AT[0])), ("c2", "find", {})], [("c1", "lookup_observation", frozen_map(timestamp="2024-01-01T00:00:00Z", mode="exact"))], []]), [("lookup_observation", frozen_map(timestamp=AT[0], mode="exact"), "{}")], "{}", '"A"'),
        ("partially_accomplished", 1, 0, 0.6667, 1, ["missing_tool:aggregate_window", "missing_final_field:stream_id", "missing_final_field:mean_value", "missing_evidence:B"]),
    ),
    "report": (
        (gold(required=("stream_id", "sample_checked_timestamp")), [("aggregate_window", asked(), "{}")], '{"stream_id": "A"}', '{"stream_ids": ["A", "B"]}'),
        ("partially_accomplished", 1, 1, 1, 1, ["missing_final_field:sample_checked_timestamp"]),
    ),
}


def test_verification(spark):
    names = list(CASES)
    tasks = spark.createDataFrame([(k, *CASES[n][0][0]) for k, n in enumerate(names)], TASK)
    # Positions descend in the table.
    calls = spark.createDataFrame([(k, len(c) - i, *c[len(c) - 1 - i]) for k, n in enumerate(names) for c in [CASES[n][0][1]] for i in range(len(c))], "task_id int, position int, tool_name string, arguments map<string,string>, output string")
    answers = spark.createDataFrame([(k, *CASES[n][0][2:]) for k, n in enumerate(names)], "task_id int, final string, evidence string")
    obs = spark.createDataFrame([("A", datetime(2024, 1, 1, 6), 1.0), ("A", datetime(2024, 1, 7), 3.0)], "stream_id string, ts timestamp, value double")
    got = {names[r["task_id"]]: r for r in W.verify(tasks, calls, answers, obs).collect()}
    for n in names:
        r, want = got[n], CASES[n][1]
        assert (r["label"], r["process_score"], r["core_score"], r["evidence_score"], r["temporal_score"], r["issues"]) == want, n
    assert got["report"]["reporting_score"] == 0.0 and got["report"]["grounding_score"] == 0.5
    assert got["nothing"]["task_score"] == pytest.approx((0 + 0.5 + 0 + 1) / 4)


def test_phases(spark):
    given = lambda *x: F.array(*[F.struct(F.lit(g).alias("good"), words(*i).alias("issues")) for g, i in x]) if x else F.array().cast("array<struct<good: boolean, issues: array<string>>>")
    assert tuple(value(spark, W.phase_checks(F.lit(0), given()))) == (1.0, [])
    assert tuple(value(spark, W.phase_checks(F.lit(3), given((True, []))))) == (0.0, ["missing_phase_answer:2", "missing_phase_answer:3"])
    assert tuple(value(spark, W.phase_checks(F.lit(2), given((False, []), (True, []))))) == (0.5, ["phase_1:invalid_answer"])
    assert tuple(value(spark, W.phase_checks(F.lit(2), given((True, []), (False, ["a", "b"]))))) == (0.5, ["phase_2:a", "phase_2:b"])
