"""A Merkle manifest: a root over all rows of a table, and a proof for each row.

Rows of a group (documents: a language) are leaves in the order of their key, every `arity` consecutive nodes become one (the last run of a level may be shorter,
even a single node), and the groups' subroots, in the groups' order, are the leaves of the tree of the root. H is SHA-256; inputs are concatenated, digests as
lowercase hex.

Leaves are sorted into ranges. Where a range begins within its group, and how large the groups at its two ends are, follows from one row for each range. With that
every task folds its range by itself; what it can't fold, fewer than 2 * arity nodes a level, is its fragment of a forest: nodes keyed by tree, level and index.
Fragments form a commutative monoid: merging takes the union and folds each run of siblings that is now complete, their number being known from the tree's size.
treeReduce merges them on the executors up to the root. The runs that merging completed (at most 2 a level and range) go to all tasks, which fold their range again
and have a path to the root for every leaf. There are at most `max_ranges` ranges, so that what is collected and broadcast is bounded whatever the table's size;
a task holds 32 bytes a leaf.

Null values are leaves' inputs as `-`; null groups and keys come first. Empty texts, repeated rows, and rows that share a key are leaves of their own; rows of one
key are ordered by their leaf digest. A group of one row is its own subroot, one group's subroot the root. A proof without siblings is H of nothing. An empty table gives an
empty result. Columns that aren't named are no part of a leaf.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.line_dedup import ascii_lower
from tidegauge.llm.shared import materialise, shared_folder

ROOT = -1  # the tree over the subroots; other trees go by their group's rank


def leaf_digest(columns: list[Column]) -> Column:
    """SHA-256 of the values, each as its UTF-8 byte count, a colon and itself, or `-`."""
    texts = [c.cast("string") for c in columns]
    return F.unhex(F.sha2(F.concat(*[F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in texts]), 256))


def fold(digests: bytes) -> bytes:
    """H of the nodes of a run, given as 32 bytes each."""
    return hashlib.sha256(digests.hex().encode()).digest()


class Forest:
    """Unresolved nodes by (tree, level, index), the number of leaves of their trees, and the runs that merging has completed, by the same key of the parent."""

    def __init__(self, arity: int) -> None:
        self.arity = arity
        self.nodes: dict[tuple[int, int, int], bytes] = {}
        self.leaves: dict[int, int] = {}
        self.runs: dict[tuple[int, int, int], bytes] = {}

    def width(self, tree: int, level: int) -> int:
        n = self.leaves[tree]
        for _ in range(level):
            n = -(-n // self.arity)
        return n

    def add(self, tree: int, level: int, index: int, digest: bytes) -> None:
        """Put a node in and fold as far as siblings are there."""
        while True:
            self.nodes[tree, level, index] = digest
            width = self.width(tree, level)
            if width == 1:
                if tree == ROOT:
                    return
                del self.nodes[tree, level, index]
                self.runs[tree, level, 0] = digest  # a subroot, kept for the leaves below it
                tree, level, index = ROOT, 0, tree
                continue
            first = index - index % self.arity
            run = [(tree, level, k) for k in range(first, min(first + self.arity, width))]
            if not all(k in self.nodes for k in run):
                return
            digests = b"".join(self.nodes.pop(k) for k in run)
            level, index = level + 1, index // self.arity
            # Level and index of the parent; the subroot's own entry has its level too, and one digest.
            self.runs[tree, -level, index] = digests
            digest = fold(digests)

    def merge(self, other: Forest) -> Forest:
        self.leaves |= other.leaves
        self.runs |= other.runs
        for (tree, level, index), digest in other.nodes.items():
            self.add(tree, level, index, digest)
        return self


class Span:
    """Consecutive nodes of one tree, folded as far as their runs are complete: levels has for each level the first index and the digests."""

    def __init__(self, arity: int, total: int, first: int, digests: bytes) -> None:
        self.arity, self.levels, self.left = arity, [], []  # left: (level, index, digest) of what can't be folded here
        width, level = total, 0
        while True:
            n = len(digests) // 32
            self.levels.append((first, digests))
            if width == 1 or not n:
                break
            up_first = -(-first // arity)
            up_last = -(-width // arity) if first + n == width else (first + n) // arity
            up_last = max(up_last, up_first) if up_first * arity < first + n else up_first
            in_runs = (min(up_first * arity, first + n), min(up_last * arity, first + n) if up_last > up_first else min(up_first * arity, first + n))
            outside = [*range(first, in_runs[0]), *range(in_runs[1], first + n)]
            self.left += [(level, k, digests[32 * (k - first) : 32 * (k - first + 1)]) for k in outside]
            digests = b"".join(fold(digests[32 * (k * arity - first) : 32 * (min((k + 1) * arity, width) - first)]) for k in range(up_first, up_last))
            first, width, level = up_first, -(-width // arity), level + 1
        self.top = digests if width == 1 and digests else None

    def run(self, level: int, index: int, width: int) -> bytes | None:
        """The nodes of a level under one parent, if all are here."""
        if level >= len(self.levels):
            return None
        first, digests = self.levels[level]
        start, stop = index * self.arity - first, min((index + 1) * self.arity, width) - first
        return digests[32 * start : 32 * stop] if start >= 0 and 32 * stop <= len(digests) else None


class Range:
    """The trees of which a range of sorted leaves holds nodes. where: rank of its first group, its rows before this range, and the sizes of its first and last group."""

    def __init__(self, arity: int, groups: int, where: tuple[int, int, int, int], sizes: list[int], leaves: bytes) -> None:
        rank, before, n_first, n_last = where
        self.arity, self.groups, self.first_rank, self.spans, self.totals = arity, groups, rank, [], []
        at, subroots, first_whole = 0, [], None
        self.forest = Forest(arity)
        self.forest.leaves[ROOT] = groups
        for k, n in enumerate(sizes):
            total = n_first if k == 0 else n_last if k == len(sizes) - 1 else n
            span = Span(arity, total, before if k == 0 else 0, leaves[32 * at : 32 * (at + n)])
            at += n
            self.spans.append(span)
            self.totals.append(total)
            if span.top is not None:
                first_whole = rank + k if first_whole is None else first_whole
                subroots.append(span.top)
            else:
                self.forest.leaves[rank + k] = total
                self.forest.nodes |= {(rank + k, level, i): d for level, i, d in span.left}
        self.over = Span(arity, groups, first_whole or 0, b"".join(subroots))
        if self.over.top is not None:
            self.forest.nodes[ROOT, len(self.over.levels) - 1, 0] = self.over.top
        self.forest.nodes |= {(ROOT, level, i): d for level, i, d in self.over.left}

    def proofs(self, runs: dict[tuple[int, int, int], bytes], changed: list[bytes | None]) -> Iterator[tuple[bytes, bytes, bytes, bytes]]:
        """(subroot, root, hash of the proof, root folded from the changed leaf or its own) of every leaf in order."""
        arity = self.arity
        kept: dict[tuple[int, int], tuple] = {}  # of each tree and level the last path

        def siblings(tree: int, span: Span, level: int, index: int, width: int) -> tuple[bytes, bytes, bytes]:
            found = span.run(level, index // arity, width)
            found = runs[tree, -(level + 1), index // arity] if found is None else found
            at = 32 * (index % arity)
            return found[:at].hex().encode(), found[at + 32 :].hex().encode(), found

        def above(tree: int, span: Span, level: int, index: int, width: int, rank: int) -> tuple[bytes, list, bytes, bytes]:
            """(all siblings, pairs of what stands left and right, subroot, root) from this node on."""
            key = tree, level
            if key in kept and kept[key][0] == index:
                return kept[key][1]
            if width == 1:
                own = span.levels[level][1] if level < len(span.levels) and span.levels[level][1] else None
                if tree != ROOT:
                    rest = above(ROOT, self.over, 0, rank, self.groups, rank)
                    out = rest[0], rest[1], own or runs[tree, level, 0], rest[3]
                else:
                    out = b"", [], b"", own or runs[ROOT, 0, -1]
            else:
                left, right, _ = siblings(tree, span, level, index, width)
                rest = above(tree, span, level + 1, index // arity, -(-width // arity), rank)
                out = left + right + rest[0], [(left, right), *rest[1]], rest[2], rest[3]
            kept[key] = index, out
            return out

        at = 0
        for k, (span, total) in enumerate(zip(self.spans, self.totals, strict=True)):
            rank = self.first_rank + k
            for key in [x for x in kept if x[0] != ROOT]:
                del kept[key]
            first, leaves = span.levels[0]
            for j in range(len(leaves) // 32):
                if total == 1:
                    proof, steps, subroot, root = above(rank, span, 0, 0, 1, rank)
                else:
                    left, right, _ = siblings(rank, span, 0, first + j, total)
                    rest = above(rank, span, 1, (first + j) // arity, -(-total // arity), rank)
                    proof, steps, subroot, root = left + right + rest[0], [(left, right), *rest[1]], rest[2], rest[3]
                node = changed[at] if changed[at] is not None else leaves[32 * j : 32 * (j + 1)]
                for left, right in steps:
                    node = hashlib.sha256(left + node.hex().encode() + right).digest()
                at += 1
                yield subroot, root, hashlib.sha256(proof).digest(), node


def _whole(batches: Iterable[pa.RecordBatch]) -> pa.Table | None:
    found = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(found) if found else None


def _sizes(column: pa.ChunkedArray) -> list[tuple[str | None, int]]:
    return [(k, sum(1 for _ in g)) for k, g in groupby(column.to_pylist())]


def _name(group: str | None) -> bytes:
    return b"" if group is None else hashlib.sha256(group.encode()).digest()


def manifest(leaves: DataFrame, arity: int = 8, per_range: int = 20_000, max_ranges: int = 4096) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root, verified of every leaf; leaves: (tree string, key, leaf, changed), digests as 32 bytes, changed null where the leaf stays.

    The groups' order is that of tree, that of leaves in them the key's.
    """
    spark = leaves.sparkSession
    shared_folder(spark)
    # A row id parts equal rows, so that a range can end among them; it is written once, as sorting reads it twice.
    rows = materialise(leaves.select("tree", "key", "leaf", "changed", F.monotonically_increasing_id().alias("row")), "leaves")
    n = rows.count()
    order = ["tree", "key", "leaf", "row"]
    # A checkpoint keeps its partitions, each a file: the ranges are the same for all jobs that follow.
    ranges = rows.repartitionByRange(min(max_ranges, n // per_range + 1), *order).sortWithinPartitions(*order).drop("row").checkpoint()
    ranges = ranges.withColumn("range", F.spark_partition_id())

    def ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (table := _whole(batches)) is not None:
            sizes = _sizes(table.column("tree"))
            cells = [table.column("range")[0].as_py(), _name(sizes[0][0]), sizes[0][1], _name(sizes[-1][0]), sizes[-1][1], len(sizes)]
            yield pa.record_batch([pa.array([x], k) for x, k in zip(cells, (pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["range", "first", "n_first", "last", "n_last", "n"])

    # One row a range.
    found = sorted(ranges.select("range", "tree").mapInArrow(ends, "range int, first binary, n_first long, last binary, n_last long, n long").collect(), key=lambda r: r["range"])
    if not found:
        return spark.createDataFrame([], "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    # A group's rows lie in neighbouring ranges: it begins in one, fills others, and ends in one.
    rank, name, before, starts, sizes = -1, None, 0, [], {}
    for r in found:
        if bytes(r["first"]) != name:
            rank, before = rank + 1, 0
        starts.append((rank, before))
        sizes[rank] = before + r["n_first"]
        if r["n"] > 1:
            rank, before = rank + r["n"] - 1, 0
            sizes[rank] = r["n_last"]
        before, name = sizes[rank], bytes(r["last"])
    groups = rank + 1
    where = {r["range"]: (k, b, sizes[k], sizes[k + r["n"] - 1]) for r, (k, b) in zip(found, starts, strict=True)}
    places = spark.sparkContext.broadcast(where)

    def fragment(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (table := _whole(batches)) is not None:
            own = Range(arity, groups, places.value[table.column("range")[0].as_py()], [n for _, n in _sizes(table.column("tree"))], b"".join(table.column("leaf").to_pylist()))
            yield pa.record_batch([pa.array([pickle.dumps(own.forest)], pa.binary())], names=["forest"])

    merged = ranges.select("range", "tree", "leaf").mapInArrow(fragment, "forest binary").rdd.map(lambda r: pickle.loads(r[0])).treeReduce(lambda a, b: Forest(arity).merge(a).merge(b), 3)
    if len(merged.nodes) != 1:
        merged = Forest(arity).merge(merged)
    (root,) = merged.nodes.values()
    merged.runs[ROOT, 0, -1] = root
    completed = spark.sparkContext.broadcast(merged.runs)

    def prove(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (table := _whole(batches)) is None:
            return
        leaf = table.column("leaf").to_pylist()
        own = Range(arity, groups, places.value[table.column("range")[0].as_py()], [n for _, n in _sizes(table.column("tree"))], b"".join(leaf))
        keys = table.column("key").combine_chunks()
        proofs, size = own.proofs(completed.value, table.column("changed").to_pylist()), 10_000
        for start in range(0, len(leaf), size):
            some = [next(proofs) for _ in range(min(size, len(leaf) - start))]
            cells = [[x[k].hex() for x in some] for k in range(4)]
            yield pa.record_batch(
                [keys.slice(start, len(some)), pa.array([x.hex() for x in leaf[start : start + len(some)]]), *map(pa.array, cells), pa.array([x[1] == x[3] for x in some])],
                names=["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
            )

    return ranges.select("range", "tree", "key", "leaf", "changed").mapInArrow(prove, "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def document_leaves(documents: DataFrame, changed_text: Column, where: Column) -> DataFrame:
    """The leaves of documents by lang and doc_id, with the digest of the row with another text where a condition holds."""
    own = leaf_digest([F.col(c) for c in COLUMNS])
    other = leaf_digest([*(F.col(c) for c in COLUMNS[:-1]), changed_text])
    return documents.select(F.col("lang").alias("tree"), F.col("doc_id").cast("long").alias("key"), own.alias("leaf"), F.when(where, other).alias("changed"))


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return manifest(document_leaves(documents, ascii_lower(F.col("text")), tampered)).withColumnRenamed("id", "doc_id")


def _op12_sql(levels: int = 12) -> str:
    """DuckDB SQL for tables of up to 8 ** levels rows a language and 8 ** levels languages: a step for each level."""
    leaf = "sha256({0})".format(" || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR END" for c in COLUMNS))
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = [f"""WITH RECURSIVE bytes AS (
  SELECT DISTINCT doc_id, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)) AS b FROM documents
), crc AS (
  SELECT doc_id, b, 0 AS i, 4294967295::BIGINT AS c FROM bytes WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT doc_id, b, i + 1, CASE WHEN xor(c, CASE WHEN i % 8 = 0 THEN b[i // 8 + 1] ELSE 0 END) & 1 = 1
    THEN xor(xor(c, CASE WHEN i % 8 = 0 THEN b[i // 8 + 1] ELSE 0 END) >> 1, 3988292384) ELSE xor(c, CASE WHEN i % 8 = 0 THEN b[i // 8 + 1] ELSE 0 END) >> 1 END
  FROM crc WHERE i < 8 * len(b)
), tampered AS (
  SELECT DISTINCT doc_id FROM crc WHERE i = 8 * len(b) AND xor(c, 4294967295) % 3 = 0
), leaves AS (
  SELECT doc_id, lang, {leaf} AS leaf, {leaf.replace('text', lower)} AS other, doc_id IN (SELECT doc_id FROM tampered) AS is_tampered FROM documents
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM leaves
), a0 AS (
  SELECT tree, i, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM ranked
), f0 AS (
  SELECT doc_id, leaf, tree, i, CASE WHEN is_tampered THEN other ELSE leaf END AS folded, '' AS proof FROM ranked
)"""]

    def level(a: str, f: str, k: int, tree: str) -> str:
        run = f"SELECT {tree} AS tree, i // 8 AS p, string_agg(h, '' ORDER BY i) AS run FROM {a}{k} WHERE n > 1 GROUP BY ALL"
        return f""", {a}{k + 1} AS (
  SELECT tree, p AS i, sha256(run) AS h, count(*) OVER (PARTITION BY tree) AS n FROM ({run})
  UNION ALL SELECT tree, i, h, n FROM {a}{k} WHERE n = 1
), {f}{k + 1} AS (
  SELECT doc_id, leaf, x.tree, CASE WHEN run IS NULL THEN x.i ELSE x.i // 8 END AS i,
         CASE WHEN run IS NULL THEN folded ELSE sha256(substr(run, 1, (64 * (x.i % 8))::BIGINT) || folded || substr(run, (64 * (x.i % 8) + 65)::BIGINT)) END AS folded,
         proof || CASE WHEN run IS NULL THEN '' ELSE substr(run, 1, (64 * (x.i % 8))::BIGINT) || substr(run, (64 * (x.i % 8) + 65)::BIGINT) END AS proof{{more}}
  FROM {f}{k} x LEFT JOIN ({run}) r ON x.tree = r.tree AND x.i // 8 = r.p
)"""

    steps += [level("a", "f", k, "tree").replace("{more}", "") for k in range(levels)]
    steps.append(f""", b0 AS (SELECT 0 AS tree, tree AS i, h, count(*) OVER () AS n FROM a{levels}
), g0 AS (SELECT x.doc_id, x.leaf, 0 AS tree, x.tree AS i, folded, proof, h AS subroot FROM f{levels} x JOIN a{levels} y ON x.tree = y.tree)""")
    steps += [level("b", "g", k, "tree").replace("{more}", ", subroot") for k in range(levels)]
    return "".join(steps) + f"""
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = h AS verified FROM g{levels}, b{levels}"""


OP12_SQL = _op12_sql()
