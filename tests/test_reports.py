"""Assembly and reports on small cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.operators import reports


def test_assembly_and_modes(spark):
    static = spark.createDataFrame([("a", "train", "f"), ("b", "train", "f"), ("c", "dev", "g")], "task_id string, split string, family string")
    episodes = reports.assembled(static, F.when(F.col("task_id") == "a", "ask").otherwise("answer"), F.when(F.col("task_id") == "a", F.array(F.lit("site"))))
    rows = {r["task_id"]: r for r in episodes.collect()}
    assert rows["a"]["slots"] == ["site"] and rows["b"]["slots"] == [] and rows["b"]["static_id"] == "b" and [h["status"] for h in rows["a"]["history"]] == ["observed", "generated"]
    got = {tuple(r)[:5] for r in reports.mode_counts(episodes).collect()}
    assert {("train", "f", "ask", 1, 1), ("train", None, None, 2, 1), (None, "f", None, 2, 1), (None, None, "answer", 2, 0), (None, None, None, 3, 1)} <= got and len(got) == 3 + 2 + 2 + 2 + 1


def test_failures(spark):
    rows = [
        ("a", "accomplished", None, True, [], [], [], [], []), ("b", "partially_accomplished", "", True, ["missing_tool:x", "missing_tool:y", "call_sequence_mismatch"], [], ["missing_tool:x"], [], []),
        ("c", "not_accomplished", "boom: empty_rank", True, ["missing_phase_answer:1"], ["missing_phase_answer:1"], [], [], []), ("d", "not_accomplished", None, False, None, None, None, None, None), ("e", "not_accomplished", None, True, ["odd"], [], [], [], ["odd"]),
    ]
    schema = "task_id string, label string, error string, traced boolean, issues array<string>, phase_issues array<string>, process_issues array<string>, temporal_issues array<string>, final_issues array<string>"
    judged = reports.failures(spark.createDataFrame(rows, schema))
    got = {r["task_id"]: (r["layer"], r["categories"], r["error_category"]) for r in judged.collect()}
    assert got["a"] == (None, [], "none") and got["b"] == ("tool_process_failure", ["process_call_sequence_mismatch", "process_required_tool_missing"], "none")
    assert got["c"] == ("controller_parse_or_binding_failure", ["protocol_phase_completion_missing"], "controller_rank_empty_result") and got["d"][0] == "protocol_trace_missing" and got["e"][:2] == ("final_answer_failure", ["other"])
    assert {tuple(r) for r in reports.report(judged).collect()} >= {("label", "not_accomplished", 3), ("category", "other", 1)}
    assert tuple(reports.witnesses(judged).first()) == (5, 1, 0.2)
