"""The widest pairs of a table without listing its pairs: differences are counted in sorted values, and only those that decide are written.

Pairs are of one site, class and window, of different streams on different equipment; a pair's difference is that of their values. Rows of one site, class and window are
sorted into blocks. How many differences of two blocks are at most t follows from a binary search for each value, less the same count within each equipment, so that the pairs
need not be made. Counting at `pivots` thresholds at a time narrows the places of the median and of a site's last wanted pair, until few enough pairs are left to list.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators.order import place
from tidegauge.tables import materialise, small_enough

CLASS = ["site_id", "point_class"]
ITEM = "array<struct<value: double, stream_id: string, equipment_label: string>>"


def reach(values: np.ndarray, base: np.ndarray, low: np.ndarray, high: np.ndarray, most: float) -> np.ndarray:
    """For each base the first place in values[low:high], which ascend, whose difference from it is over `most`; subtraction as it is rounded, which keeps the order."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        mid = (low + high) // 2
        fits = open_ & (values[np.minimum(mid, len(values) - 1)] - base <= most)
        low, high = np.where(fits, mid + 1, low), np.where(open_ & ~fits, mid, high)
    return low


class Block:
    """The values of two blocks of a window (or of one with itself), and of the same equipment among them."""

    def __init__(self, left: pa.StructScalar, right: pa.StructScalar) -> None:
        self.same = not right.is_valid
        one = [left.values.field(k) for k in range(3)]
        two = one if self.same else [right.values.field(k) for k in range(3)]
        self.left, self.right = one[0].to_numpy(), two[0].to_numpy()
        self.items = one, two
        labels = pa.concat_arrays([one[2], two[2]]).dictionary_encode().indices.to_numpy()
        self.code_left, self.code_right = labels[: len(self.left)], labels[len(self.left) :]
        everything = self._bounds(len(self.left), len(self.right))
        a, b = np.lexsort((self.left, self.code_left)), np.lexsort((self.right, self.code_right))
        start, stop = (np.searchsorted(self.code_right[b], self.code_left[a], side=x) for x in ("left", "right"))
        if self.same:
            start = np.arange(len(a)) + 1
        self.parts = ((self.right, self.left, *everything), (self.right[b], self.left[a], start, np.maximum(start, stop)))

    def _bounds(self, n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
        return np.arange(n) + 1 if self.same else np.zeros(n, np.int64), np.full(n, m)

    def count(self, most: float) -> int:
        """Pairs on different equipment whose difference is at most that."""
        every, own = (int((reach(v, base, low, high, most) - low).sum()) for v, base, low, high in self.parts)
        return every - own

    def pairs(self, over: float, most: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(left, right, difference) of the pairs on different equipment with a difference over one and at most the other."""
        values, base, low, high = self.parts[0]
        first, last = reach(values, base, low, high, over), reach(values, base, low, high, most)
        i = np.repeat(np.arange(len(base)), last - first)
        j = np.arange(len(i)) - np.repeat(np.cumsum(last - first) - (last - first), last - first) + np.repeat(first, last - first)
        apart = self.code_left[i] != self.code_right[j]
        i, j = i[apart], j[apart]
        return i, j, values[j] - base[i]


def block_pairs(rows: DataFrame, size: int = 2048) -> DataFrame:
    """site_id, point_class, window_start, left_items, right_items (null: the block with itself) of all blocks of a window; rows: those and stream_id, equipment_label, value."""
    key = [*CLASS, "window_start"]
    placed = place(rows, key, [F.col("value"), F.col("stream_id")], "place")
    item = F.struct("value", "stream_id", "equipment_label")
    blocks = placed.groupBy(*key, F.floor((F.col("place") - 1) / size).alias("block")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    blocks = materialise(blocks, "pair-blocks")
    # Only windows of several blocks meet in the join: all but their last block are full.
    left = blocks.where(F.size("items") == size).select(*key, F.col("block").alias("left_block"), F.col("items").alias("left_items"))
    right = blocks.where("block > 0").select(*key, F.col("block").alias("right_block"), F.col("items").alias("right_items"))
    across = left.join(right, key).where("left_block < right_block").select(*key, "left_items", "right_items")
    alone = blocks.select(*key, F.col("items").alias("left_items"), F.lit(None).cast(ITEM).alias("right_items"))
    return alone.unionByName(across)


def _each(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, Block]]:
    for batch in batches:
        left, right = batch.column("left_items"), batch.column("right_items")
        for i in range(batch.num_rows):
            yield batch, i, Block(left[i], right[i])


def counts(blocks: DataFrame, thresholds: DataFrame) -> DataFrame:
    """site_id, point_class, step, at, n: how many differences are at most each of a class's thresholds (array `cuts`, numbered from 0)."""
    asked = blocks.join(small_enough(thresholds), CLASS).select(*CLASS, "step", "cuts", "left_items", "right_items")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, block in _each(batches):
            found = [block.count(t) for t in batch.column("cuts")[i].as_py()]
            k = len(found)
            yield pa.record_batch([*(pa.array([batch.column(c)[i].as_py()] * k, t) for c, t in zip((*CLASS, "step"), (pa.string(), pa.string(), pa.int32()), strict=True)), pa.array(range(k), pa.int32()), pa.array(found, pa.int64())], names=[*CLASS, "step", "at", "n"])

    return asked.mapInArrow(run, "site_id string, point_class string, step int, at int, n long").groupBy(*CLASS, "step", "at").agg(F.sum("n").alias("n"))


def number_of_pairs(rows: DataFrame) -> DataFrame:
    """site_id, point_class, pairs, widest: pairs on different equipment in one window, and a bound on their differences."""

    def twos(keys: list[str], name: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.count("*").alias("n")).groupBy(*CLASS).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("long").alias(name))

    window = [*CLASS, "window_start"]
    bounds = rows.groupBy(*CLASS).agg((F.max("value") - F.min("value")).alias("widest"))
    both = twos(window, "every").join(twos([*window, "equipment_label"], "own"), CLASS).join(bounds, CLASS)
    return both.select(*CLASS, (F.col("every") - F.col("own")).alias("pairs"), "widest").where("pairs > 0")


def _cuts(low: Column, high: Column, pivots: int) -> Column:
    """Thresholds from low on, evenly up to high itself."""
    return F.concat(F.transform(F.sequence(F.lit(1), F.lit(pivots - 1)), lambda i: low + (high - low) * (i / pivots)), F.array(high))


def median_gap(blocks: DataFrame, sizes: DataFrame, bounded: int = 10_000, pivots: int = 16) -> DataFrame:
    """site_id, point_class, min_gap: the exact median of all differences of a class. sizes: number_of_pairs().

    Each of the two middle places lies between two thresholds; counting at those between narrows them by the number of pivots, until at most `bounded` differences are left
    or the thresholds are neighbouring numbers, of which the upper one is the answer.
    """
    steps = F.explode(F.array(F.lit(0), F.lit(1))).alias("step")
    middle = F.floor((F.col("pairs") - 1) / 2)
    target = sizes.select(*CLASS, "pairs", "widest", steps).select(
        *CLASS, "step", F.least(middle + F.col("step"), F.col("pairs") - 1).cast("long").alias("rank"), (F.col("pairs") % 2 == 0).alias("even"),
        F.lit(-1.0).alias("low"), F.col("widest").alias("high"), F.lit(0).cast("long").alias("below"), F.col("pairs").alias("left"),
    )
    between = F.col("low") + (F.col("high") - F.col("low")) / 2
    target = materialise(target, "median")
    open_ = (F.col("left") > bounded) & (between > F.col("low")) & (between < F.col("high"))
    while target.where(open_).limit(1).count():
        some = target.where(open_).withColumn("cuts", _cuts(F.col("low"), F.col("high"), pivots))
        counted = counts(blocks, some.select(*CLASS, "step", "cuts"))
        # The last threshold with no more than rank differences up to it, and the first with more.
        at = some.join(counted, [*CLASS, "step"]).withColumn("cut", F.get("cuts", F.col("at")))
        under, over = F.col("n") <= F.col("rank"), F.col("n") > F.col("rank")
        new = at.groupBy(*target.columns).agg(
            F.max(F.when(under, F.struct("n", "cut"))).alias("a"), F.min(F.when(over, F.struct("n", "cut"))).alias("b"),
        ).select(
            *CLASS, "step", "rank", "even", F.coalesce("a.cut", "low").alias("low"), F.col("b.cut").alias("high"), F.coalesce("a.n", "below").alias("below"), (F.col("b.n") - F.coalesce("a.n", "below")).alias("left"),
        )
        target = materialise(new.select(*target.columns).unionByName(target.where(~open_)), "median")
    # What few are left, by value; where many are, they are all one value.
    few = target.where(F.col("left") <= bounded)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, block in _each(batches):
            values, n = np.unique(block.pairs(batch.column("low")[i].as_py(), batch.column("high")[i].as_py())[2], return_counts=True)
            k = len(values)
            yield pa.record_batch([*(pa.array([batch.column(c)[i].as_py()] * k, t) for c, t in zip((*CLASS, "step"), (pa.string(), pa.string(), pa.int32()), strict=True)), pa.array(values, pa.float64()), pa.array(n, pa.int64())], names=[*CLASS, "step", "diff", "n"])

    listed = blocks.join(small_enough(few), CLASS).select(*CLASS, "step", "low", "high", "left_items", "right_items").mapInArrow(run, "site_id string, point_class string, step int, diff double, n long")
    by_value = listed.groupBy(*CLASS, "step", "diff").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*CLASS, "step").orderBy("diff").rowsBetween(Window.unboundedPreceding, 0))
    ranked = by_value.withColumn("upto", upto).join(few, [*CLASS, "step"])
    hit = ranked.where((F.col("upto") + F.col("below") > F.col("rank")) & (F.col("upto") - F.col("n") + F.col("below") <= F.col("rank")))
    answers = hit.select(*CLASS, "step", "even", "diff").unionByName(target.where(F.col("left") > bounded).select(*CLASS, "step", "even", F.col("high").alias("diff")))
    a, b = (F.max(F.when(F.col("step") == k, F.col("diff"))) for k in (0, 1))
    return answers.groupBy(*CLASS, "even").agg(a.alias("a"), b.alias("b")).select(*CLASS, F.when(F.col("even"), F.col("a") + (F.col("b") - F.col("a")) * 0.5).otherwise(F.col("a")).alias("min_gap"))


def _site_floor(blocks: DataFrame, classes: DataFrame, wanted: int, slack: int = 8, pivots: int = 16) -> DataFrame:
    """site_id, floor: a difference that at least `wanted` pairs of the site exceed among those that reach their class's cut, and not many more; 0 where there are fewer. classes: sizes with min_gap."""
    # Half of a class's pairs, at least, lie at its median or above.
    first = classes.groupBy("site_id").agg(F.lit(0.0).alias("low"), F.max("widest").alias("high"), F.sum("pairs").alias("n"))
    site = materialise(first, "floors")
    between = F.col("low") + (F.col("high") - F.col("low")) / 2
    open_ = (F.col("n") > slack * wanted) & (between > F.col("low")) & (between < F.col("high"))
    while site.where(open_).limit(1).count():
        some = site.where(open_).withColumn("sites_cuts", _cuts(F.col("low"), F.col("high"), pivots))
        asked = classes.join(some.select("site_id", "sites_cuts"), "site_id").select(*CLASS, F.lit(0).alias("step"), F.transform("sites_cuts", lambda t: F.greatest(t, F.col("min_gap"))).alias("cuts"))
        over = counts(blocks, asked).join(classes, CLASS).groupBy("site_id", "at").agg(F.sum(F.col("pairs") - F.col("n")).alias("over"))
        at = some.join(over, "site_id").withColumn("cut", F.get("sites_cuts", F.col("at")))
        enough = F.col("over") >= wanted
        new = at.groupBy("site_id", "low", "high", "n").agg(F.max(F.when(enough, F.struct("cut", "over"))).alias("a"), F.min(F.when(~enough, F.col("cut"))).alias("b"))
        site = materialise(new.select("site_id", F.coalesce("a.cut", "low").alias("low"), F.coalesce("b", "high").alias("high"), F.coalesce("a.over", "n").alias("n")).unionByName(site.where(~open_)), "floors")
    return site.select("site_id", F.col("low").alias("floor"))


def widest_pairs(rows: DataFrame, per_site: int = 2500, bounded: int = 10_000, size: int = 2048, pivots: int = 16) -> DataFrame:
    """The per_site widest pairs of each site among those that differ at all and at least by the median of their class; site_rank, min_gap and both sides' columns.

    rows: site_id, point_class, window_start, stream_id, equipment_label, value, one for each stream and window, none null. Equal differences go by class, window and streams. No pair
    is listed but the few that decide the median and those that can be among the widest, at most per_site of two blocks.
    """
    rows = materialise(rows.select(*CLASS, "window_start", "stream_id", "equipment_label", "value"), "pair-rows")
    blocks = block_pairs(rows, size)
    sizes = materialise(number_of_pairs(rows), "pair-sizes")
    classes = materialise(sizes.join(median_gap(blocks, sizes, bounded, pivots), CLASS), "pair-classes")
    floors = _site_floor(blocks, classes, per_site, pivots=pivots)
    bounds = materialise(classes.join(floors, "site_id").select(*CLASS, "min_gap", "floor"), "pair-bounds")
    names = ["left_stream_id", "left_equipment_label", "left_mean_value", "right_stream_id", "right_equipment_label", "right_mean_value", "diff_value"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, block in _each(batches):
            cut, floor = batch.column("min_gap")[i].as_py(), batch.column("floor")[i].as_py()
            a, b, diff = block.pairs(max(floor, float(np.nextafter(cut, -np.inf))), np.inf)
            if len(diff) > per_site:
                least = np.partition(diff, len(diff) - per_site)[len(diff) - per_site]
                a, b, diff = a[diff >= least], b[diff >= least], diff[diff >= least]
            one, two = ([column.take(pa.array(k)) for column in items] for k, items in zip((a, b), block.items, strict=True))
            turned = np.array(one[1].to_pylist(), object) > np.array(two[1].to_pylist(), object)
            pick = pa.array(turned.astype(bool), pa.bool_())
            left, right = ([pc.if_else(pick, y, x) for x, y in zip(p, q, strict=True)] for p, q in ((one, two), (two, one)))
            out = pa.record_batch([left[1], left[2], left[0], right[1], right[2], right[0], pa.array(diff)], names=names)
            if len(diff) > per_site:
                # Equal differences go by the streams.
                out = out.sort_by([("diff_value", "descending"), ("left_stream_id", "ascending"), ("right_stream_id", "ascending")]).slice(0, per_site)
            keys = [pa.array([batch.column(c)[i].as_py()] * out.num_rows, batch.schema.field(c).type) for c in (*CLASS, "window_start", "min_gap")]
            yield pa.record_batch([*keys, *out.columns], names=[*CLASS, "window_start", "min_gap", *names])

    kind = dict(rows.dtypes)["window_start"]
    schema = f"site_id string, point_class string, window_start {kind}, min_gap double, left_stream_id string, left_equipment_label string, left_mean_value double, right_stream_id string, right_equipment_label string, right_mean_value double, diff_value double"
    found = blocks.join(small_enough(bounds), CLASS).select(*CLASS, "window_start", "min_gap", "floor", "left_items", "right_items").mapInArrow(run, schema)
    # A site has about eight times per_site rows here, and with many equal differences at most per_site of two blocks.
    order = Window.partitionBy("site_id").orderBy(F.desc("diff_value"), "point_class", "window_start", "left_stream_id", "right_stream_id")
    return found.withColumn("site_rank", F.row_number().over(order)).where(F.col("site_rank") <= per_site)
