"""Readers and sinks round trip."""

from __future__ import annotations

import pickle
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import catalog
from tidegauge.schema import OBSERVATIONS
from tidegauge.sources import archive, readers, sinks, turtle
from tidegauge.streaming import daily


def test_metadata_headers_and_sites(spark, tmp_path):
    (tmp_path / "Site_A_points.csv").write_text("Stream ID,Brick Class,Equipment\n0a1b2c3d-1111-2222-3333-444455556666,Sensor, \n,Sensor,x\n")
    (tmp_path / "Site-b.csv").write_text("uuid,label\np1,nan\n")
    got = {r.stream_id: r for r in readers.load_metadata(spark, [str(p) for p in tmp_path.iterdir()]).collect()}
    assert set(got) == {"0a1b2c3d_1111_2222_3333_444455556666", "p1"}
    assert got["p1"].site_id == "B" and got["p1"].point_label is None
    assert got["0a1b2c3d_1111_2222_3333_444455556666"].equipment_label is None


def test_wide_and_semicolon_csv(spark, tmp_path):
    wide = spark.createDataFrame([("u", datetime(2024, 1, 1), "1.5", "x")], "unit string, ts timestamp_ntz, a string, b string")
    assert [(r.stream_id, r.value) for r in readers.load_wide(wide, ["unit", "ts"], {"a": "temp", "b": "flow"}, "S").collect()] == [("u_temp", 1.5)]
    (tmp_path / "d.csv").write_text("IDdevice;Date;V2\n1;2024-01-01 00:10:00;1,0\n1;2024-01-01 00:50:00;2,0\n9;2024-01-01 00:50:00;2,0\n")
    devices = spark.createDataFrame([("1", "room")], "device string, prefix string")
    assert [(r.stream_id, r.ts, r.value) for r in readers.load_sensor_csv(spark, str(tmp_path / "d.csv"), devices, {"V2": "temp"}, "S").collect()] == [("room_temp", datetime(2024, 1, 1), 1.5)]


def test_turtle_and_its_graph(spark, tmp_path):
    (tmp_path / "g.ttl").write_text('@prefix b: <http://b#> .\n# note\nb:p a b:Point, b:Temp ; b:isPointOf b:e ; b:label "x \\"y\\"" .\nb:e b:hasLocation b:r ; b:ref [ a b:Ref ; b:id "7" ] .\n')
    (tmp_path / "bad.ttl").write_text("b:p b:q {")
    rows = turtle.load_turtle(spark, str(tmp_path)).collect()
    good = {(r.s, r.p, r.o, r.is_literal) for r in rows if r.problem is None}
    assert ("b:p", "rdf:type", "b:Temp", False) in good and ("b:p", "b:label", 'x "y"', True) in good and ("b:e", "b:ref", "_:b1", False) in good and ("_:b1", "b:id", "7", True) in good
    assert [r.path.endswith("bad.ttl") for r in rows if r.problem] == [True]
    triples = spark.createDataFrame([r for r in rows if r.problem is None], turtle.SCHEMA).select("s", F.regexp_replace("p", "^b:", "").alias("p"), "o", "is_literal")
    _, relations = catalog.graph_tables(triples)
    points = spark.createDataFrame([("b:p",)], "point_entity string")
    assert catalog.stream_targets(points, relations).first().asDict() == {"point_entity": "b:p", "equipment_entity": "b:e", "location_entity": "b:r"}


class Evil:
    def __reduce__(self):
        return (print, ("never",))


def test_archive_skips_bad_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("Site_A/s1.pickle", pickle.dumps(("Site_A_s1", [datetime(2024, 1, 1), "rubbish"], [1.0, 2.0])))
        z.writestr("Site_A/s2.pickle", pickle.dumps(Evil()))
        z.writestr("note.txt", "x")
    rows = archive.load_archive(spark, str(tmp_path / "a.zip")).cache()
    assert [(r.member_name, r.error_type) for r in archive.errors(rows).collect()] == [("Site_A/s2.pickle", "UnpicklingError")]
    assert [(r.stream_id, r.n_points) for r in archive.raw_index(rows).collect()] == [("site_a_s1", 2)] or archive.raw_index(rows).first().n_points == 2
    assert archive.observations(rows, "A").where("ts is not null").first().value == 1.0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("t1", "train", 1), ("t2", "dev", 2)], "task_id string, split string, n int")
    sinks.write_jsonl(df, str(tmp_path / "j"))
    assert readers.read_jsonl(spark, str(tmp_path / "j"), "task_id string, n int, split string").count() == 2
    sinks.append_parquet(df.withColumn("site_id", F.lit("S")), str(tmp_path / "p"), OBSERVATIONS)
    assert spark.read.parquet(str(tmp_path / "p")).columns == OBSERVATIONS.names
    assert sinks.training_rows(df, ["a", "b"]).count() == 4
    sinks.write_lineage_csv(df, str(tmp_path / "c"), "split", "task_id")
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2


@pytest.mark.parametrize("period", ["day", "week"])
def test_stream_equals_batch(spark, small, tmp_path, period):
    events = spark.read.parquet(f"{small}/events.parquet")
    cols = [F.lit("S").alias("site_id"), F.col("user_id").cast("string").alias("stream_id"), "ts", "value"]
    for k in range(2):
        events.where(F.col("event_id") % 2 == k).select(*cols).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(OBSERVATIONS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = daily.run_available(spark, stream, str(tmp_path / "out"), period, "10000 days")
    want = daily.windowed(events.select(*cols), period)
    assert got.count() == want.count() > 0 and got.exceptAll(want).isEmpty()


def test_stream_drops_what_is_late_and_keeps_what_was(spark, tmp_path):
    cols = "site_id string, stream_id string, ts timestamp_ntz, value double"

    def run(*rows):
        spark.createDataFrame([("S", "a", datetime(2024, 1, d, h), v) for d, h, v in rows], cols).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(OBSERVATIONS).parquet(str(tmp_path / "in"))
        return {r["window_start"].day: (r["count"], r["mean_value"]) for r in daily.run_available(spark, stream, str(tmp_path / "out")).collect()}

    assert run((1, 1, 1.0), (20, 1, 2.0)) == {1: (1, 1.0), 20: (1, 2.0)}
    # A day old is in time, 19 days are not.
    assert run((19, 5, 4.0), (20, 2, 4.0)) == {1: (1, 1.0), 19: (1, 4.0), 20: (2, 3.0)}
    assert run((1, 2, 9.0), (21, 1, 5.0)) == {1: (1, 1.0), 19: (1, 4.0), 20: (2, 3.0), 21: (1, 5.0)}


def test_escapes_in_turtle():
    rows = list(turtle.triples('b:p b:label "caf\\u00e9 \\u20AC \\U0001F600 \\t\\"x\\" é" .'))
    assert rows == [("b:p", "b:label", 'café € \U0001F600 \t"x" é', True)]


def test_metadata_statistics(spark, tmp_path):
    (tmp_path / "Site_C_metadata.csv").write_text("Stream GUID,Units,Num Points,Average,Std,Start Timestamp,last_t\n0a1b2c3d-1111-2222-3333-444455556666,degC,12,1.5,x,2024-01-01,2024-01-02T03:00:00Z\n")
    (r,) = readers.load_metadata(spark, [str(tmp_path / "Site_C_metadata.csv")]).collect()
    assert (r.stream_id, r.unit, r["count"], r.mean_value, r.std_value, r.min_value) == ("0a1b2c3d_1111_2222_3333_444455556666", "degC", 12, 1.5, None, None)
    assert r.first_ts == datetime(2024, 1, 1) and r.last_ts == datetime(2024, 1, 2, 3)


def test_means_of_small_and_large_values(spark):
    from tidegauge.functions.columns import exact_mean, snake_case

    def mean(*values):
        return spark.createDataFrame([(v,) for v in values], "v double").agg(exact_mean("v").alias("m")).first()["m"]

    assert mean(1e-7, 3e-7) == 2e-7 and mean(1e15, 3e15) == 2e15 and mean(0.1, 0.2, None) == 0.15 and mean(None) is None
    names = ["pointClass", " A-b  C", "HTTPServer2Name", "x1Y", "__", "Éa_b"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(snake_case("n")).collect()]
    assert got == ["point_class", "a_b_c", "httpserver2_name", "x1_y", "", "a_b"] == [readers._snake(n) for n in names]
