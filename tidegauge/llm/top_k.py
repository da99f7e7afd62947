"""Exact top-k search by inner product over integer vectors, coarse to fine.

A vector is cut into 1, 2, 4, ... segments; of each segment its mean m and standard deviation s are kept. With segments of w components,
|x - y|^2 >= sum over segments of w * ((m_x - m_y)^2 + (s_x - s_y)^2), a distance's lower bound that grows with the number of segments; as
|x - y|^2 = |x|^2 + |y|^2 - 2 xy, an inner product is at most the sum of w * (m_x m_y + s_x s_y). A pair whose bound lies below the query's k-th best score so far is
out; what survives all levels is multiplied out exactly.

Vectors are written in blocks, with their statistics. Queries are dealt to groups of about `queries` by the hash of their row, and every group meets every block in one
of `spread` streams: a task reads its group's queries, then block after block, and holds no more than both and the best k so far; the streams' best are
merged. Nothing is broadcast or collected, whatever the number of queries.

Components x become floor(scale * x). Null vectors, and those with null or non-finite components, take no part; empty ones do. Vectors of unequal length are compared as if the
shorter one went on with zeros. Ties go to the smaller id (null last). Rows are told apart by themselves: a repeated row is a candidate of the other one, and each is a
query. Rows without id are candidates only. Scores beyond 64 bits stay at the limit of long. An empty table, or one without queries, gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.shared import materialise

_LONG = 2**63 - 1
_EXACT = 2.0**53  # whole numbers below are exact as doubles, sums and products too


def whole_numbers(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) of finite doubles, as doubles where all are small enough to be exact and else as Python's integers."""
    with np.errstate(over="ignore"):
        out = np.floor(values * scale)
    if not len(out) or np.abs(out).max() < _EXACT:
        return out
    # Doubles from 2**53 on are whole numbers themselves.
    return np.array([int(x) * int(scale) if abs(x) >= _EXACT else math.floor(x * scale) for x in values.tolist()], object)


def statistics(vectors: np.ndarray) -> list[np.ndarray]:
    """For each resolution a row for each vector: means and deviations times the root of the segment's size, so that the product of two such rows bounds theirs."""
    n, d = vectors.shape
    out, segments = [], 1
    while segments * 4 <= d:
        edges = np.arange(segments) * d // segments
        size = np.diff(np.append(edges, d))
        mean = np.add.reduceat(vectors, edges, axis=1) / size
        deviation = np.sqrt(np.maximum(np.add.reduceat((vectors - np.repeat(mean, size, axis=1)) ** 2, edges, axis=1) / size, 0))
        out.append(np.hstack([mean, deviation]) * np.sqrt(np.concatenate([size, size])))
        segments *= 2
    return out


def _wide(rows: list[np.ndarray], d: int) -> np.ndarray:
    """Rows as one matrix of d columns, zeros where a row is shorter."""
    out = np.zeros((len(rows), d), object if any(r.dtype == object for r in rows) else np.float64)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


class Best:
    """The k best of each query so far, and the score that a candidate has to reach."""

    def __init__(self, vectors: np.ndarray, own: list[tuple[int, int]], k: int) -> None:
        self.vectors, self.k = vectors, k
        self.block, self.place = np.array(own, np.int64).T
        self.small = vectors.dtype != object
        # Products and sums of rows with these largest components must stay exact.
        self.most = float(np.abs(vectors).max(initial=0)) if self.small else 0
        self.statistics = statistics(vectors) if self.small else []
        self.norm = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1)) if self.small else None
        self.least = np.full(len(vectors), -np.inf)
        self.query, self.id, self.found = (np.zeros(0, np.int64) for _ in range(3))

    def survivors(self, candidates: np.ndarray, levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of query and candidate that no level's bound rules out."""
        # What floating point may lose on a bound.
        norms = np.sqrt((candidates**2).sum(axis=1))
        slack = 1e-9 * (1 + self.norm[:, None] * norms[None, :])
        q = c = None
        for mine, theirs in zip(self.statistics, levels, strict=True):
            if q is None or len(q) * 8 > len(self.least) * len(candidates):
                keep = mine @ theirs.T + slack >= self.least[:, None]
                if q is not None:
                    before = np.zeros_like(keep)
                    before[q, c] = True
                    keep &= before
                q, c = np.nonzero(keep)
            else:
                keep = np.concatenate([np.zeros(0, bool)] + [np.einsum("ij,ij->i", mine[q[s : s + 65536]], theirs[c[s : s + 65536]]) for s in range(0, len(q), 65536)]) + slack[q, c] >= self.least[q]
                q, c = q[keep], c[keep]
        if q is None:
            q, c = (x.ravel() for x in np.indices((len(self.least), len(candidates))))
        return q, c

    def add(self, block: int, ids: np.ndarray, candidates: np.ndarray, levels: list[np.ndarray]) -> None:
        d = max(candidates.shape[1], self.vectors.shape[1])
        exact = self.small and candidates.dtype != object and self.most * float(np.abs(candidates).max(initial=0)) * max(d, 1) < _EXACT
        if exact and candidates.shape[1] == self.vectors.shape[1]:
            q, c = self.survivors(candidates, levels)
            if len(q) * 8 > len(self.least) * len(candidates):
                scores = (self.vectors @ candidates.T)[q, c]
            else:
                scores = np.concatenate([np.zeros(0)] + [np.einsum("ij,ij->i", self.vectors[q[s : s + 65536]], candidates[c[s : s + 65536]]) for s in range(0, len(q), 65536)])
            scores = scores.astype(np.int64)
        else:
            # Other lengths, or numbers too large for doubles: all pairs of the block.
            n = min(candidates.shape[1], self.vectors.shape[1])
            a, b = self.vectors[:, :n], candidates[:, :n]
            if exact:
                scores = (a @ b.T).astype(np.int64).ravel()
            else:
                a, b = (np.array([[int(x) for x in r] for r in m.tolist()], object).reshape(len(m), n) for m in (a, b))
                scores = np.array([max(-_LONG - 1, min(_LONG, x)) for x in (a.dot(b.T) if n else np.zeros((len(a), len(b)), object)).ravel().tolist()], np.int64)
            q, c = (x.ravel() for x in np.indices((len(a), len(b))))
        keep = ((self.block[q] != block) | (self.place[q] != c)) & (scores >= self.least[q])
        q, c, scores = q[keep], c[keep], scores[keep]
        query, ident, found = np.concatenate([self.query, q]), np.concatenate([self.id, ids[c]]), np.concatenate([self.found, scores])
        # ~x falls as x grows, also at the ends of long.
        order = np.lexsort((ident, ~found, query))
        query, ident, found = query[order], ident[order], found[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        self.query, self.id, self.found = query[rank < self.k], ident[rank < self.k], found[rank < self.k]
        at_k = rank == self.k - 1
        self.least[query[at_k]] = np.where(np.abs(found[at_k]) < 2**53, found[at_k].astype(np.float64), np.nextafter(found[at_k].astype(np.float64), -np.inf))


_NO_ID = 2**63 - 1  # null ids go last among ties


def blocks(vectors: DataFrame, id_column: str, column: str, scale: float, size: int = 2048, most_bytes: int = 1 << 20) -> DataFrame:
    """Blocks of vectors: block, d, ids, numbers (little-endian longs; text where one is larger), wide."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            lists = batch.column(1)
            kept: dict[int, list[tuple[int, np.ndarray]]] = {}
            for k in range(batch.num_rows):
                if not lists[k].is_valid:
                    continue
                x = lists[k].values
                values = x.to_numpy(zero_copy_only=False).astype(np.float64) if not x.null_count else None
                if values is not None and np.isfinite(values).all():
                    kept.setdefault(len(values), []).append((int(ids[k]), values))
            for d, rows in kept.items():
                step = max(1, min(size, most_bytes // (8 * max(d, 1))))
                for s in range(0, len(rows), step):
                    some = rows[s : s + step]
                    numbers = whole_numbers(np.concatenate([v for _, v in some]) if d else np.zeros(0), scale)
                    wide = numbers.dtype == object
                    packed = " ".join(map(str, numbers.tolist())).encode() if wide else numbers.astype("<i8").tobytes()
                    cells = [[d], [len(some)], [np.array([i for i, _ in some], "<i8").tobytes()], [packed], [wide]]
                    yield pa.record_batch([pa.array(x, t) for x, t in zip(cells, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.bool_()), strict=True)], names=["d", "n", "ids", "numbers", "wide"])

    packed = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(column).cast("array<double>").alias("vector")).mapInArrow(run, "d int, n int, ids binary, numbers binary, wide boolean")
    return packed.withColumn("block", F.monotonically_increasing_id())


def _unpack(numbers: bytes, wide: bool, n: int, d: int) -> np.ndarray:
    if wide:
        return np.array([int(x) for x in numbers.split()], object).reshape(n, d)
    return np.frombuffer(numbers, "<i8").astype(np.float64).reshape(n, d)


def top_k(vectors: DataFrame, id_column: str, column: str, every: int, k: int = 5, scale: float = 256.0, queries: int = 1024, size: int = 2048, spread: int = 8) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of the highest inner product for every row whose id is divisible by `every`."""
    packed = materialise(blocks(vectors, id_column, column, scale, size), "blocks")

    def pick(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], "<i8")
                chosen = np.flatnonzero((ids % every == 0) & (ids != _NO_ID))
                if not len(chosen):
                    continue
                m = _unpack(r["numbers"], r["wide"], r["n"], r["d"])
                rows = [" ".join(str(int(x)) for x in m[j].tolist()).encode() if r["wide"] else m[j].astype("<i8").tobytes() for j in chosen]
                yield pa.record_batch(
                    [pa.array([r["block"]] * len(rows), pa.int64()), pa.array(chosen, pa.int64()), pa.array([r["d"]] * len(rows), pa.int32()), pa.array([ids[j : j + 1].tobytes() for j in chosen], pa.binary()), pa.array(rows, pa.binary()), pa.array([r["wide"]] * len(rows))],
                    names=["block", "place", "d", "ids", "numbers", "wide"],
                )

    asked = materialise(packed.select("block", "d", "n", "ids", "numbers", "wide").mapInArrow(pick, "block long, place long, d int, ids binary, numbers binary, wide boolean"), "queries")
    groups = -(-asked.count() // queries)
    if not groups:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    one = asked.select(
        F.pmod(F.xxhash64("block", "place"), F.lit(groups)).cast("int").alias("query_group"), F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("stream"), F.lit(0).alias("kind"), "block", "place", "d", F.lit(1).alias("n"), "ids", "numbers", "wide"
    )
    each = packed.select(
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("query_group"), F.pmod(F.xxhash64("block"), F.lit(spread)).cast("int").alias("stream"), F.lit(1).alias("kind"), "block", F.lit(-1).cast("long").alias("place"), "d", "n", "ids", "numbers", "wide"
    )

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, best, names = None, [], None, []

        def done() -> Iterator[pa.RecordBatch]:
            if best is not None and len(best.query):
                where = [names[i] for i in best.query.tolist()]
                yield pa.record_batch([pa.array([w[0] for w in where], pa.int64()), pa.array([w[1] for w in where], pa.int64()), pa.array([w[2] for w in where], pa.int64()), pa.array(best.id, pa.int64()), pa.array(best.found, pa.int64())], names=["block", "place", "query_id", "vec_id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                r = {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}
                if (r["query_group"], r["stream"]) != now:
                    yield from done()
                    now, waiting, best = (r["query_group"], r["stream"]), [], None
                if not r["kind"]:
                    waiting.append(r)
                    continue
                if best is None:
                    if not waiting:
                        continue
                    rows = [_unpack(w["numbers"], w["wide"], 1, w["d"])[0] for w in waiting]
                    names = [(w["block"], w["place"], int(np.frombuffer(w["ids"], "<i8")[0])) for w in waiting]
                    best = Best(_wide(rows, max(w["d"] for w in waiting)), [w[:2] for w in names], k)
                    waiting = []
                m = _unpack(r["numbers"], r["wide"], r["n"], r["d"])
                best.add(r["block"], np.frombuffer(r["ids"], "<i8"), m, statistics(m) if not r["wide"] else [])
        yield from done()

    streams = one.unionByName(each).repartition("query_group", "stream").sortWithinPartitions("query_group", "stream", "kind", "block", "place")
    found = streams.mapInArrow(search, "block long, place long, query_id long, vec_id long, score long")
    order = Window.partitionBy("block", "place").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.when(F.col("vec_id") != _NO_ID, F.col("vec_id")).alias("vec_id"), "score")


def op13_exact_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", every=50)


OP13_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
