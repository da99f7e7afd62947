"""Places, running totals and quantiles against numpy and plain Python, with hot groups, ties, nulls and few ranges."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators.order import place, quantiles, running_total


def rows_of_groups() -> list[tuple]:
    rng = np.random.default_rng(4)
    hot = [("a", "x", float(v)) for v in rng.normal(size=900)]
    ties = [("a", None, float(v)) for v in rng.integers(0, 3, 400)]
    heavy = [("b", "x", float(10.0**v)) for v in rng.uniform(-200, 200, 300)]
    few = [(None, "y", 1.5), ("c", "z", None), ("c", "w", 2.0), ("c", "w", None), ("c", "v", -1.0), ("c", "v", 4.0)]
    return hot + ties + heavy + few + hot[:50]


@pytest.mark.parametrize("ranges", [1, 7])
def test_places_and_totals(spark, ranges):
    rows = [(k, *r) for k, r in enumerate(rows_of_groups())]
    df = spark.createDataFrame(rows, "id long, s string, c string, v double").repartition(5)
    got = {r["id"]: r["n"] for r in place(df, ["s", "c"], [F.col("v").desc(), F.col("id")], "n", ranges).collect()}
    groups = defaultdict(list)
    for r in rows:
        groups[r[1:3]].append(r)
    want = {}
    for g in groups.values():
        g.sort(key=lambda r: (r[3] is None, -(r[3] or 0), r[0]))
        want |= {r[0]: k + 1 for k, r in enumerate(g)}
    assert got == want
    total = {r["id"]: r["t"] for r in running_total(df, [], [F.col("id")], F.when(F.col("v") > 0, 2), "t", ranges).collect()}
    sums, so_far = {}, 0
    for r in rows:
        so_far += 2 if r[3] is not None and r[3] > 0 else 0
        sums[r[0]] = so_far
    assert total == sums


@pytest.mark.parametrize(("bounded", "bins"), [(100_000, 64), (40, 8), (1, 4)])
def test_quantiles(spark, bounded, bins):
    rows = rows_of_groups()
    df = spark.createDataFrame(rows, "s string, c string, v double").repartition(5)
    shares = {"low": 0.1, "mid": 0.5, "high": 0.995, "least": 0.0, "most": 1.0}
    got = {(r["s"], r["c"]): [r[n] for n in shares] for r in quantiles(df, ["s", "c"], F.col("v"), shares, bounded, bins).collect()}
    groups = defaultdict(list)
    for s, c, v in rows:
        if v is not None:
            groups[s, c].append(v)
    assert got.keys() == groups.keys()
    for k, values in groups.items():
        values.sort()
        for q, x in zip(shares.values(), got[k], strict=True):
            at = q * (len(values) - 1)
            lower, upper = values[int(at)], values[min(int(at) + 1, len(values) - 1)]
            assert x == lower + (upper - lower) * (at - int(at))
    (whole,) = quantiles(df, [], F.col("v"), {"mid": 0.5}, bounded, bins).collect()
    assert whole["mid"] == pytest.approx(float(np.percentile([v for *_, v in rows if v is not None], 50)), rel=1e-12)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([("a", None)], "s string, v double")
    assert quantiles(df, ["s"], F.col("v"), {"q": 0.5}).count() == 0
    assert quantiles(df, [], F.col("v"), {"q": 0.5}).collect()[0]["q"] is None
    assert place(df.where("false"), ["s"], [F.col("v")], "n").count() == 0
