"""Operators on tasks, calls and requests in words: missing values, ties, empty tables."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidegauge.functions import decisions as D
from tidegauge.functions import texts as X
from tidegauge.operators import episodes, scoring, tools
from tidegauge.operators import summaries as S
from tidegauge.schema import OBSERVATIONS

CALLS = "task_id long, position int, call_id string, tool_name string, arguments map<string,string>"


def value(spark, column, **row):
    schema = ", ".join(f"{k} {'timestamp_ntz' if isinstance(v, datetime) else 'int' if isinstance(v, int) else 'string'}" for k, v in row.items()) or "x int"
    return spark.createDataFrame([tuple(row.values()) or (1,)], schema).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("text", "day"),
    [("on March  3, 2024 or 2023-01-01", datetime(2024, 3, 3)), ("at 2023-01-31.", datetime(2023, 1, 31)), ("february 30, 2024", None), ("in may", None), (None, None)],
)
def test_dates_in_words(spark, text, day):
    assert value(spark, X.date_in("t"), t=text) == day


def test_times_in_words(spark):
    text = "at 7:05:30.25 UTC on May 1, 2024"
    assert value(spark, X.instant_in("t"), t=text) == datetime(2024, 5, 1, 7, 5, 30, 250000)
    assert value(spark, X.instant_in("t"), t="at 7:05 on May 1, 2024") is None
    w = value(spark, X.window_in("f", "t"), f="window_rank", t="during December 2023")
    assert (w["start"], w["end"], w["period"]) == (datetime(2023, 12, 1), datetime(2024, 1, 1), "month")
    assert value(spark, X.window_in("f", "t"), f="day_mean_lookup", t="no day") is None
    words = value(spark, X.time_phrase("f", F.col("r"), F.col("r"), F.col("r")), f="timestamp_value_lookup", r=datetime(2024, 5, 1, 7, 5, 30, 250000))
    assert words == "07:05:30.25 UTC on May 1, 2024" and value(spark, X.instant_in("t"), t=words) == datetime(2024, 5, 1, 7, 5, 30, 250000)


def test_names_in_words(spark):
    assert value(spark, X.class_phrases("c"), c="Room_Sensor") == ["room measurement", "room reading", "room sensor"]
    assert value(spark, X.class_phrases("c"), c="Sensor") == ["sensor"] and value(spark, X.class_phrases("c"), c=None) == []
    assert value(spark, X.label_variants("c"), c="A_1 Fan Coil Unit 7") == ["a 1 fan coil unit 7", "a 1 fcu 7", "fan coil unit 7"]


def test_json_values(spark):
    assert value(spark, X.ids_in("j"), j='{"stream_id": "a", "x": [{"stream_id":"b"}], "other_stream_id": "c", "stream_id": 3}') == ["a", "b"]
    assert value(spark, X.numbers_in("j"), j="x1 has 2.5 and -3, v_4") == [2.5, -3.0]
    assert value(spark, X.ids_in("j"), j='{"stream_id": "a\\"b"}') == ['a"b']
    rows = spark.createDataFrame([(float("nan"), "NaN", 1.5, None)], "a double, b string, c double, d string")
    assert X.clean_json(rows, "a", "b", "c", "d").first()["json"] == '{"b":"NaN","c":1.5}'


def test_call_sequences(spark):
    calls = spark.createDataFrame([(1, 1, None, "echo", {"x": "7"}), (1, 2, None, "echo", {"x": "$c1.list[0].x", "y": "$c9.x", "z": "$c1.none", "w": "$5.00 rate"}), (1, 3, None, "gone", {}), (2, 1, "a", "echo", {})], CALLS)
    echo = lambda asked: asked.withColumn("output", F.to_json(F.struct(F.array(F.struct(F.col("arguments")["x"].alias("x"))).alias("list"))))
    rows = {(r["task_id"], r["position"]): r for r in tools.execute_sequences(calls, {"echo": echo}, steps=2).collect()}
    assert len(rows) == 4 and rows[1, 2]["arguments"] == {"x": "7", "y": "$c9.x", "z": None, "w": "$5.00 rate"}
    assert rows[1, 2]["output"] == rows[1, 1]["output"] == '{"list":[{"x":"7"}]}' and rows[1, 3]["output"] is None and rows[2, 1]["call_id"] == "a"
    assert tools.execute_sequences(calls.limit(0), {"echo": echo}, steps=2).count() == 0


def test_scores_of_tasks(spark):
    t = datetime(2024, 1, 1)
    needs = spark.createDataFrame([(1, "a", "c1", "t", t, t), (1, "a", "c2", "u", t, t), (1, "b", "c1", "t", t, t), (2, "a", "c1_sample", "t", t, t), (3, "a", None, "t", t, t)], "task_id long, variant string, call_id string, tool string, window_start timestamp_ntz, window_end timestamp_ntz")
    calls = needs.where("task_id = 1 and call_id = 'c1'").select("task_id", "tool", "window_start", "window_end")
    assert sorted(tuple(r) for r in scoring.temporal_best(needs, calls).collect()) == [(1, 1.0), (2, 1.0), (3, 0.0)]
    phases = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "task_id long, phase int")
    answers = spark.createDataFrame([(1, 1, True), (2, 1, True)], "task_id long, phase int, good boolean")
    assert sorted(tuple(r) for r in scoring.phase_score(phases, answers).collect()) == [(1, 0.0), (2, 1.0)]
    one = F.lit(1.0)
    v = value(spark, scoring.verdict(F.lit(0.0), one, one, one, one, one))
    assert (v["task"], v["label"], v["strict_label"]) == (1.0, "accomplished", "partially_accomplished")


def test_neighbouring_windows(spark):
    day = lambda n: datetime(2024, 1, n)
    obs = spark.createDataFrame([("S", "a", day(1), 1.0), ("S", "b", day(1), float("nan")), ("S", "a", day(3), 2.0), ("S", "b", day(3), 2.0)], OBSERVATIONS)
    asked = spark.createDataFrame([("q", "a", "b", "S", day(2), day(3)), ("r", "a", "b", "S", day(9), day(10))], "request_id string, left_stream_id string, right_stream_id string, group string, window_start timestamp_ntz, window_end timestamp_ntz")
    r = episodes.adjacent_compare(obs, asked).collect()
    assert [(x["request_id"], x["direction"], x["winning_stream_id"]) for x in r] == [("q", "next", "b")]
    members = spark.createDataFrame([("S", "a"), ("S", "b")], "group string, stream_id string")
    r = episodes.adjacent_rank(obs, asked, members).collect()
    assert [(x["request_id"], x["direction"], x["stream_id"], x["mean_value"]) for x in r] == [("q", "previous", "a", 1.0)]
    assert episodes.adjacent_rank(obs.limit(0), asked, members).count() == 0


def test_summaries(spark):
    rows = spark.createDataFrame([("a", 1, None), ("a", 2, "x"), ("b", 1, "y"), ("b", 2, "z"), ("c", 1, None)], "k string, o int, v string")
    assert [tuple(r) for r in S.constant_groups(rows, ["k"], "v").collect()] == [("a", "x")]
    assert sorted(r["k"] for r in S.last_two(rows, "k", "o", ["v"]).collect()) == ["a", "b"]
    assert {r["k"]: r["alternate"] for r in S.other_member(rows.where("o = 1").withColumn("g", F.lit(1)), ["g"], "k").collect()} == {"a": "b", "b": "a", "c": "a"}
    assert [r["n"] for r in S.standardized(rows.where("k = 'c'").select(F.col("o").cast("double").alias("n")), ["n"]).collect()] == [0.0]
    assert value(spark, S.combinations_up_to(F.lit(4), 6)) == 15 and value(spark, S.combinations_up_to(F.lit(0), 2)) == 0
    hits = S.phrase_hits(spark.createDataFrame([(1, "The air flow!"), (2, None), (3, "airflow")], "id int, t string"), "id", "t", spark.createDataFrame([("air", "A"), ("air flow", "B")], "phrase string, value string"))
    assert sorted(tuple(r) for r in S.longest_hit(hits, "id").collect()) == [(1, "B", "air flow")]


def test_commitment_by_prompt(spark):
    def of(action, offset, prompt):
        return value(spark, D.prompted_commitment(F.lit(action), F.lit(None).cast("string"), F.lit(False), F.lit(offset).cast("double"), F.lit(prompt)))["action"]

    assert [of("abstain", 1, "x"), of("answer", 31, "a more precise timestamp"), of("answer", 31, None), of(None, None, "a more precise timestamp")] == ["abstain", "re_clarify", "answer", "answer"]
