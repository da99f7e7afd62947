"""Operators on rows that the test data don't have: missing values, ties, empty tables."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidegauge.functions import columns as K
from tidegauge.operators import aggregates as A
from tidegauge.operators import asof, audit, selection, tools
from tidegauge.schema import OBSERVATIONS, WINDOW_AGGREGATE, conform

T0 = datetime(2024, 1, 1)


def obs(spark, rows):
    return spark.createDataFrame([("S", s, T0 + timedelta(seconds=t) if t is not None else None, v) for s, t, v in rows], OBSERVATIONS)


def one(df):
    return df.first().asDict()


def test_quality_of_missing_constant_and_duplicate_values(spark):
    rows = [("a", 0, 1.0), ("a", 10, float("nan")), ("a", 20, 1.0), ("a", 20, 0.0), ("a", 60, float("inf")), ("a", None, 5.0)]
    q = one(A.quality(obs(spark, rows)))
    assert (q["n_points"], q["median_step_seconds"], q["longest_gap_seconds"]) == (5, 10.0, 40.0)
    assert q["nan_fraction"] == 0.4 and q["duplicate_timestamp_fraction"] == 0.2
    # Finite values in order are 1, 0, 1: by value within an instant, and what isn't finite parts nothing.
    assert abs(q["zero_fraction"] - 1 / 3) < 1e-6 and q["constant_fraction"] == 0.0
    assert abs(q["observed_fraction"] - 5 / 7) < 1e-6


def test_quality_of_one_point_and_of_none(spark):
    q = one(A.quality(obs(spark, [("a", 0, 1.0)])))
    assert q["observed_fraction"] is None and q["median_step_seconds"] is None and q["constant_fraction"] is None
    assert A.quality(obs(spark, [])).count() == 0


def test_weeks_start_on_tuesday_and_windows_end_at_the_next(spark):
    rows = [("a", 0, 1.0), ("a", 86400, 3.0), ("a", 86400 * 20, float("nan")), ("a", 86400 * 22, 5.0)]
    w = A.summarize(obs(spark, rows), "week").orderBy("window_start").collect()
    assert [r.window_start for r in w] == [datetime(2023, 12, 26), datetime(2024, 1, 2), datetime(2024, 1, 23)]
    assert [r.window_end for r in w] == [datetime(2024, 1, 2), datetime(2024, 1, 23), datetime(2024, 1, 30)]
    assert [r.std_value for r in w] == [None, None, None]


def test_preview_has_numpy_places(spark):
    for n in (95, 96, 97, 200, 517):
        got = [r.i for r in A.previews(obs(spark, [("a", t, float(t)) for t in range(n)])).orderBy("i").collect()]
        assert got == (list(range(n)) if n <= 96 else sorted(set(np.linspace(0, n - 1, 96).astype(int).tolist())))


def test_nearest_takes_the_earlier_of_two(spark):
    o = obs(spark, [("a", 0, 1.0), ("a", 10, 2.0), ("a", 10, 1.5), ("b", 5, 9.0)])
    probes = spark.createDataFrame([(1, "a", T0 + timedelta(seconds=5)), (2, "a", T0 + timedelta(seconds=10)), (3, "a", T0 - timedelta(seconds=3)), (4, "a", T0 + timedelta(seconds=99)), (5, "c", T0)], "probe_id bigint, stream_id string, probe_ts timestamp_ntz")
    got = {r.probe_id: (r.value, r.offset_seconds, r.exact_match_found) for r in asof.nearest(o, probes).collect()}
    assert got == {1: (1.0, 5.0, False), 2: (1.5, 0.0, True), 3: (1.0, 3.0, False), 4: (got[4][0], 89.0, False)}
    assert {r.probe_id: r.found for r in asof.exact(o, probes).collect()} == {1: False, 2: True, 3: False, 4: False, 5: False}


def test_aggregate_window_of_nothing_and_ties(spark):
    o = obs(spark, [("a", 0, 1.0), ("b", 0, 1.0)])
    stored = conform(A.summarize(obs(spark, []), "day"), WINDOW_AGGREGATE)
    asked = spark.createDataFrame([("x", "a", "day", T0, T0 + timedelta(days=1)), ("y", "b", "day", T0, T0 + timedelta(days=1)), ("z", "a", "day", T0 + timedelta(days=3), T0 + timedelta(days=4))], "request_id string, stream_id string, period string, window_start timestamp_ntz, window_end timestamp_ntz")
    results = tools.aggregate_window(o, stored, asked)
    assert {r.request_id: (r["count"], r.mean_value) for r in results.collect()} == {"x": (1, 1.0), "y": (1, 1.0), "z": (0, None)}
    pairs = spark.createDataFrame([("p", "x", "y"), ("q", "x", "z")], "request_id string, left_request string, right_request string")
    assert {r.request_id: r.winner for r in tools.compare_window(results, pairs).collect()} == {"p": "b", "q": None}
    assert [r.stream_id for r in tools.rank_window(results, ["window_start"]).collect()] == ["b"]


def test_take_by_split_equals_a_loop(spark):
    rng = np.random.default_rng(1)
    rows = pd.DataFrame({"k": range(300), "site": rng.choice(["a", "b", "held"], 300), "kind": rng.choice(list("xyz"), 300)})
    targets, caps = {"train": 40, "dev": 10, "test": 10}, {"train": 7, "dev": 3, "test": 5}
    want, seen, used, taken = [], 0, {}, {"train": 0, "dev": 0, "test": 0}
    for r in rows.itertuples():
        split = "test" if r.site == "held" else "dev" if seen % 5 == 4 else "train"
        seen += r.site != "held"
        if taken[split] < targets[split] and used.get((split, r.kind), 0) < caps[split]:
            used[split, r.kind] = used.get((split, r.kind), 0) + 1
            taken[split] += 1
            want.append((r.k, split))
    got = selection.take_by_split(spark.createDataFrame(rows), ["k"], "site = 'held'", ["kind"], targets, caps)
    assert sorted((r.k, r.split) for r in got.collect()) == sorted(want)


def test_text_functions(spark):
    def value(c):
        return spark.range(1).select(c.alias("x")).first().x

    assert value(K.snake_case(F.lit(" pointClass-Name (x)"))) == "point_class_name_x"
    assert value(K.normalize_text(F.lit(" Zone--Temp_1 "))) == "zone temp 1" and value(K.normalize_text(F.lit("nan"))) is None
    assert value(K.normalize_label(F.lit("`Site_A  Unit 1`"), F.lit("SITE_A"))) == "unit 1"
    assert value(K.candidate_key(F.lit("A"), F.lit(None).cast("string"), F.lit("c d"))) == "a||c d"
    assert value(K.normalize_stream_id(F.lit("x 0A1B2C3D-1111-2222-3333-444455556666"))) == "0a1b2c3d_1111_2222_3333_444455556666"
    assert value(K.local_name(F.lit("http://a/b#C"))) == "C" and value(K.local_name(F.lit("http://a/b"))) == "b"
    assert value(K.iso_text(F.lit("2024-01-01 00:00:01").cast("timestamp_ntz"))) == "2024-01-01T00:00:01"
    assert value(K.iso_text(F.lit("2024-01-01 00:00:01.5").cast("timestamp_ntz"))) == "2024-01-01T00:00:01.500000"
    assert value(K.same_instant(F.lit("2024-01-01T00:00:00Z"), F.lit("2024-01-01 00:00:00"))) and not value(K.same_instant(F.lit("rubbish"), F.lit("rubbish")))
    assert value(K.number_variants(F.lit(2.5))) == ["2.5000", "2.500", "2.50", "2.5"]
    assert value(K.within(F.lit("1.05"), F.lit(1.0), 0.1)) and not value(K.within(F.lit("x"), F.lit(1.0), 0.1))


def test_difference_counts_repeated_rows(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "x int"), spark.createDataFrame([(1,), (3,)], "x int")
    assert sorted((r.x, r.side) for r in audit.difference(a, b).collect()) == [(1, "left"), (2, "left"), (3, "right")]
    assert audit.fingerprint(a).first() == audit.fingerprint(a.repartition(3)).first() != audit.fingerprint(b).first()


def test_numbers_as_text_round_by_their_binary_value(spark):
    import random

    from tidegauge.functions import columns as K

    r = random.Random(3)
    values = [0.0, 0.5, 2.5, 0.125, 2222.25, 2.675, 1.005, -0.25, -1.35, 99999.99995, 0.00005, 12345678901.0625, 3e11]
    values += [round(r.uniform(-1e6, 1e6), k) for k in range(6) for _ in range(200)] + [r.randrange(10**6) / 2**k for k in range(8) for _ in range(50)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for row in df.select("v", *[K.fixed("v", n).alias(f"t{n}") for n in (1, 2, 3, 4)]).collect():
        assert [row[f"t{n}"] for n in (1, 2, 3, 4)] == [f"{row.v:.{n}f}" for n in (1, 2, 3, 4)]
