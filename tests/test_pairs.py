"""The widest pairs against all pairs listed, with large windows, many equal values and narrow bounds that force counting."""

from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np
import pytest

from tidegauge.operators.pairs import Block, block_pairs, widest_pairs


def rows(kind: str) -> list[tuple]:
    rng = np.random.default_rng(6)
    out = []
    for site, cls, week, n in [("a", "x", 1, 70), ("a", "x", 2, 40), ("a", "y", 1, 25), ("b", "x", 1, 60), ("b", "z", 3, 2), ("c", "x", 1, 1), ("d", "x", 1, 30)]:
        for k in range(n):
            value = {"normal": float(rng.normal() * 10), "ties": float(rng.integers(0, 4)), "same": 1.0, "spread": float(10.0 ** rng.uniform(-9, 9))}[kind]
            out.append((site, cls, week, f"s{site}{k}", f"e{k % 7}" if site != "d" else "one", value))
    return out


def listed(data: list[tuple], per_site: int) -> list[tuple]:
    groups = defaultdict(list)
    for site, cls, week, stream, unit, value in data:
        groups[site, cls, week].append((stream, unit, value))
    by_class = defaultdict(list)
    for (site, cls, week), items in groups.items():
        for p, q in itertools.combinations(sorted(items), 2):
            if p[1] != q[1]:
                by_class[site, cls].append((abs(p[2] - q[2]), week, p, q))
    out = defaultdict(list)
    for (site, cls), pairs in by_class.items():
        d = sorted(x[0] for x in pairs)
        a, b = d[(len(d) - 1) // 2], d[len(d) // 2]
        cut = a + (b - a) * 0.5
        out[site] += [(-x, cls, week, p, q, cut) for x, week, p, q in pairs if x > 0 and x >= cut]
    return sorted((site, k + 1, cls, week, *p, *q, -x, cut) for site, all_of in out.items() for k, (x, cls, week, p, q, cut) in enumerate(sorted(all_of, key=lambda r: (*r[:3], r[3][0], r[4][0]))[:per_site]))


@pytest.mark.parametrize(("kind", "per_site", "bounded", "size"), [("same", 2500, 10_000, 2048), ("normal", 20, 100, 16), ("ties", 20, 15, 16), ("spread", 200, 300, 32)])
def test_widest_pairs(spark, kind, per_site, bounded, size):
    data = rows(kind)
    df = spark.createDataFrame(data, "site_id string, point_class string, window_start int, stream_id string, equipment_label string, value double").repartition(3)
    names = ["site_id", "site_rank", "point_class", "window_start", "left_stream_id", "left_equipment_label", "left_mean_value", "right_stream_id", "right_equipment_label", "right_mean_value", "diff_value", "min_gap"]
    got = sorted(map(tuple, widest_pairs(df, per_site, bounded, size).select(*names).collect()))
    assert got == listed(data, per_site)


def test_counts_of_blocks(spark):
    data = rows("ties")
    df = spark.createDataFrame(data, "site_id string, point_class string, window_start int, stream_id string, equipment_label string, value double")
    items = block_pairs(df, 16).toArrow()
    for most in (-1.0, 0.0, 1.0, 2.5, 9.0):
        found = sum(Block(a, b).count(most) for a, b in zip(items["left_items"], items["right_items"], strict=True))
        assert found == sum(p[4] != q[4] and abs(p[5] - q[5]) <= most for p, q in itertools.combinations(data, 2) if p[:3] == q[:3])
        assert found == sum(len(Block(a, b).pairs(-1.0, most)[0]) for a, b in zip(items["left_items"], items["right_items"], strict=True))
