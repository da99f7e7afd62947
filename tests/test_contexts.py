"""Contexts of phases, difficulty, risks, traces and checksums on small cases."""

from __future__ import annotations

import hashlib
import json

from tidegauge.operators import contexts
from tidegauge.sources import checksums


def m(**x):
    return {k: json.dumps(v) for k, v in x.items()}


CALLS = "array<struct<tool_name: string, arguments: map<string,string>>>"


def tasks(spark):
    w = {"window_start": "a", "window_end": "b"}
    rows = [
        (1, "day_mean_lookup", "week", [m(stream_id="p", **w)], []),
        (2, "window_mean_lookup", "odd", [m(stream_id="p", **w), m(stream_id="", **w), m(stream_id="q", window_start="c", window_end="d")], [("aggregate_window", m(stream_id="$c1.stream_id", **w))]),
        (3, "window_pairwise_compare", None, [m(winning_stream_id="x"), m(winning_stream_id="y"), m(winning_stream_id="z")], [("resolve_point", m(e="1")), ("compare_window", m(period="month", **w)), ("compare_window", m(window_start="c", window_end="d", period="custom"))]),
        (4, "quality_gate", "day", [m(stream_id="g", window_start="s"), m(stream_id="h", period="day", **w)], [("inspect_quality_window", m(window_end="e", period="month"))]),
        (5, "poem", "day", [m(stream_id="p", **w)], None),
        (6, "window_rank", "day", None, []),
    ]
    return spark.createDataFrame(rows, f"task_id int, family string, period string, phase_golds array<map<string,string>>, calls {CALLS}")


def test_contexts_of_phases(spark):
    got = sorted(map(tuple, contexts.phase_contexts(tasks(spark)).collect()))
    assert got == [
        (1, 1, "p", "a", "b", "day"), (2, 1, "p", "a", "b", "week"), (2, 3, "q", "c", "d", "week"), (3, 1, "x", "a", "b", "month"), (3, 2, "y", "c", "d", "week"), (4, 1, "g", "s", "e", "month"), (4, 2, "h", "a", "b", "day"),
    ]


def test_difficulty_and_risks(spark):
    hard = {r["task_id"]: tuple(r)[1:] for r in contexts.difficulty(tasks(spark)).collect()}
    assert hard[2] == (1, 2, 1, 1, 2) and hard[3] == (2, 4, 0, 2, 2) and hard[1] == (0, 0, 0, 0, 0)
    rows = spark.createDataFrame([("f", [1, 2], [[1]], ["t"]), ("f", [1], [[1], [2]], ["t"]), ("g", None, None, None)], "family string, phase_golds array<int>, variants array<array<int>>, turns array<string>")
    assert {tuple(r) for r in contexts.risks(rows).collect()} == {("f", "phases", 2, 1), ("f", "phases", 1, 1), ("f", "variants", 1, 1), ("f", "variants", 2, 1), ("f", "misfit", 0, 1), ("f", "misfit", -1, 1), ("g", "phases", 0, 1), ("g", "variants", 0, 1), ("g", "misfit", -1, 1)}


def test_traces(spark):
    static = spark.createDataFrame([("s1", "{}"), ("s2", "{}")], "task_id string, json string")
    final = spark.createDataFrame([("t1", "s1", ["a", "b"], '{"x": 1.0, "y": 2}'), ("t2", "s9", ["a", "z"], "{}"), ("t3", "s2", [], "{}")], "task_id string, static_id string, stream_ids array<string>, json string")
    sources = spark.createDataFrame([("a", "one.zip"), ("b", "two.zip")], "stream_id string, source string")
    replays = spark.createDataFrame([("t1", '{"y":2,"x":1}'), ("t3", '{"n":1}')], "task_id string, json string")
    runs = spark.createDataFrame([("t1", "m", "accomplished")], "task_id string, model string, label string")
    got = {r["task_id"]: r for r in contexts.traces(static, final, sources, replays, runs).collect()}
    assert got["t1"]["problems"] == [] and got["t1"]["sources"] == ["one.zip", "two.zip"] and got["t1"]["label"] == "accomplished" and got["t1"]["release_digest"] == got["t1"]["replay_digest"]
    assert got["t2"]["problems"] == ["no_static", "no_source", "no_replay"] and got["t3"]["problems"] == ["no_source", "replay_differs"]


def test_checksums(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"x" * 3_000_000)
    (tmp_path / "b").write_bytes(b"")
    digest = lambda b: hashlib.sha256(b).hexdigest()
    files = spark.createDataFrame([(str(tmp_path / "a"), digest(b"x" * 3_000_000).upper()), (str(tmp_path / "b"), digest(b"y")), (str(tmp_path / "c"), "")], "path string, expected string")
    got = {r["path"][-1]: (r["bytes"], r["problem"]) for r in checksums.verified(files).collect()}
    assert got == {"a": (3_000_000, None), "b": (0, "differs"), "c": (None, "missing")}
