"""Near copies by the Jaccard similarity of word shingles: SimHash with deletion-variant signatures first, an exact prefix-filter join of the rest after it.

1. Texts with the same words (A-Z in lower case) form a class; only one document of a class goes on.
2. The fingerprint adds up the bits of the distinct words' hashes, each with the word's rarity (log of documents over documents with it, counted over the whole corpus in
   2**18 hashed cells) as weight, so that a few changed words turn few bits: 128 bits in four segments of 32.
3. Every segment is indexed with each of its bits as a wildcard and equal variants are joined: every member of a variant is compared with the variant's hub (the member that
   shares most variants, hence the text that the others were made from), those that it doesn't match with the next hub, for `rounds` rounds. Pairs within max_bits are verified
   on their exact shingle sets. A variant with n members costs n pairs a round, never all of them.
4. Fingerprints only save work; what they leave apart meets in an exact join. Each document has the first shingles of its set in the order of their hashes, `least` more than a
   single common one would need, so that of these a similar pair shares at least `least` (all, where it needs fewer). Among them each document's most frequent ones can
   again be left out, as many as must be shared less one; what stays is joined, and pairs of different components are compared: by the parity maps of their whole sets while they
   are joined, which differ in no more bits than the sets in shingles, by how many of these they share, then on all their first shingles, then on whole sets.
5. Components of verified links; the smallest doc_id of each group stays.

The groups are those of brute force: every pair of the similarity or more is in one group, and no pair under it is linked.

Null and empty texts are one class. Rows without doc_id stay and link to nothing. Repeated rows of one doc_id and text count as one document, different texts under one doc_id as
two. Texts of fewer words than a shingle are compared whole. Very long texts are read whole. An empty table gives an empty result. Extra columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.batches import mix, run_hashes, text_buffer, text_slices, word_spans
from tidegauge.llm.components import components
from tidegauge.llm.shared import join_spread, materialise, small_enough

SEGMENTS, LENGTH = 4, 32
CELLS = 1 << 18
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, A-Z in lower case; bounds of the texts among them)."""
    data, offsets = text_buffer(column)
    starts, ends, before = word_spans(data, offsets)
    return run_hashes(_LOWER[data], starts, ends), before


def distinct_words(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each text's distinct words."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((words, text))
    text, words = text[order], words[order]
    new = np.ones(len(words), bool)
    new[1:] = (np.diff(text) != 0) | (words[1:] != words[:-1])
    return text[new], words[new]


def rarity(documents: DataFrame) -> np.ndarray:
    """The weight of each cell of words; at most CELLS counts reach the driver."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.int64)
        for batch in text_slices(batches):
            _, words = distinct_words(*lower_words(batch.column(0)))
            counts += np.bincount((words % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
        used = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(used), pa.array(counts[used])], names=["cell", "n"])

    cells = documents.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.ones(CELLS)
    counts[cells.column(0).to_numpy()] = cells.column(1).to_numpy()
    return np.maximum(np.log(max(2, documents.count()) / counts), 1e-3).astype(np.float32)


def shingle_sets(words: np.ndarray, bounds: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's shingles; a shorter text is one shingle."""
    for a, b in zip(bounds, bounds[1:], strict=False):
        at = np.arange(a, max(a, b - width) + 1)
        yield np.unique(run_hashes(words[a:b], at - a, np.minimum(at + width, b) - a))


def class_names(words: np.ndarray, bounds: np.ndarray) -> list[pa.Array]:
    """Two 64-bit names of each text's word sequence."""
    return [pa.array(run_hashes(mix(words ^ np.uint64(salt)), bounds[:-1], bounds[1:]).view(np.int64)) for salt in (0, 0x5BD1E995)]


def needed(size: Column, similarity: float) -> Column:
    """How many shingles a set of this size shares with any that reach the similarity."""
    return F.ceil(F.lit(similarity) * size - 1e-9)


PRINTS = "doc_id long, text_key long, class1 long, class2 long, fp0 long, fp1 long, size int, prefix array<long>, parity array<long>"

#: Longs of a parity map. Two sets' maps differ in at most as many bits as there are shingles in only one of them.
PARITY = 8


def parity_map(own: np.ndarray) -> np.ndarray:
    """For each cell of a hash of the shingles, whether an odd number of them falls in it."""
    odd = np.bincount((own % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def with_keys(documents: DataFrame) -> DataFrame:
    """doc_id, text_key, text of the rows with a doc_id."""
    return documents.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("text_key"), "text")


def prints(documents: DataFrame, weights: np.ndarray, similarity: float, width: int, least: int) -> DataFrame:
    """PRINTS of every row: the class, the fingerprint, and of the size shingles the first ones by their hashes."""
    shared = documents.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 256 << 10):
            words, bounds = lower_words(batch.column(2))
            text, distinct = distinct_words(words, bounds)
            sums = np.zeros((batch.num_rows, 128), np.float32)
            # So many words at a time that their signs stay small, however long a text is.
            for at in range(0, len(text), 16_384):
                owner, some = text[at : at + 16_384], distinct[at : at + 16_384]
                raw = np.stack([mix(some + np.uint64(1)), mix(some ^ np.uint64(0xABCDEF0123456789))], axis=1).view(np.uint8)
                signs = np.unpackbits(raw.reshape(len(some), 16), axis=1).astype(np.float32)
                signs -= np.float32(0.5)
                signs *= shared.value[(some % np.uint64(CELLS)).astype(np.int64)][:, None]
                heads = np.flatnonzero(np.diff(owner, prepend=-1))
                sums[owner[heads]] += np.add.reduceat(signs, heads, axis=0)
            halves = np.packbits(sums > 0, axis=1).view(np.int64)
            sizes, firsts, maps = [], [], [np.zeros(0, np.int64)]
            for own in shingle_sets(words, bounds, width):
                need = int(np.ceil(similarity * len(own) - 1e-9))
                sizes.append(len(own))
                maps.append(parity_map(own))
                firsts.append(own[: len(own) - need + min(least, need)].view(np.int64))
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in firsts])]), pa.int32())
            prefix = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int64), *firsts])))
            parity = pa.ListArray.from_arrays(pa.array(np.arange(len(maps)) * PARITY, pa.int32()), pa.array(np.concatenate(maps)))
            columns = [batch.column(0), batch.column(1), *class_names(words, bounds), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(sizes, pa.int32()), prefix, parity]
            yield pa.record_batch(columns, names=[x.split()[0] for x in PRINTS.split(", ")])

    return with_keys(documents).mapInArrow(run, PRINTS)


def verified(pairs: DataFrame, documents: DataFrame, reps: DataFrame, similarity: float, width: int) -> DataFrame:
    """The pairs (a, b) of classes whose shingle sets reach the similarity; only texts of classes in a pair are read into sets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 128 << 10):
            words, bounds = lower_words(batch.column(2))
            sets = [own.view(np.int64) for own in shingle_sets(words, bounds, width)]
            yield pa.record_batch([class_names(words, bounds)[0], pa.array(sets, pa.list_(pa.int64()))], names=["class1", "shingles"])

    wanted = materialise(pairs.select(F.explode(F.array("a", "b")).alias("class1")).distinct(), "wanted")
    wanted = materialise(reps.select("class1", "doc_id", "text_key").join(small_enough(wanted), "class1", "left_semi").select("doc_id", "text_key"), "wanted")
    texts = with_keys(documents).join(small_enough(wanted), ["doc_id", "text_key"], "left_semi")
    sets = materialise(texts.mapInArrow(run, "class1 long, shingles array<long>").dropDuplicates(["class1"]), "shingles")
    left, right = sets.select(F.col("class1").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("class1").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(left, "a").join(right, "b").where(both >= F.lit(similarity) * (F.size("x") + F.size("y") - both)).select("a", "b")


def members_of_variants(reps: DataFrame) -> DataFrame:
    """key, class1, fp0, fp1, n of every representative and one-wildcard segment variant that n > 1 of them share."""
    low = F.lit((1 << LENGTH) - 1)
    segments = [x for h in ("fp0", "fp1") for x in (F.col(h).bitwiseAND(low), F.shiftrightunsigned(h, LENGTH))]
    variants = [F.lit((s * LENGTH + i) << LENGTH).cast("long").bitwiseOR(x.bitwiseAND(F.lit(((1 << LENGTH) - 1) ^ (1 << i)))) for s, x in enumerate(segments) for i in range(LENGTH)]
    keys = reps.select("class1", "fp0", "fp1", F.explode(F.array(*variants)).alias("key"))
    shared = materialise(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "variants-shared")
    # What shuffles if the shared ones are many: Spark sizes the keys by the rows before they are exploded, and would broadcast them.
    return keys.hint("shuffle_merge").join(small_enough(shared), "key")


def linked_by_hubs(members: DataFrame, documents: DataFrame, reps: DataFrame, similarity: float, width: int, max_bits: int, rounds: int) -> list[DataFrame]:
    """Tables a, b of verified links between members of variants and the variants' hubs."""
    score = members.groupBy("class1").agg(F.sum("n").alias("score"))
    left = materialise(members.drop("n").join(score, "class1"), "variants")
    links = []
    for _ in range(rounds):
        hubs = left.groupBy("key").agg(F.max(F.struct("score", F.col("class1").alias("hub"), F.col("fp0").alias("h0"), F.col("fp1").alias("h1"))).alias("h"), F.count("*").alias("n"))
        hubs = materialise(hubs.where("n > 1").select("key", "h.hub", "h.h0", "h.h1", "n"), "hubs")
        if hubs.isEmpty():
            break
        apart = sum(F.bit_count(F.col(f"fp{h}").bitwiseXOR(F.col(f"h{h}"))) for h in (0, 1))
        tried = join_spread(left, hubs, ["key"]).where("class1 <> hub")
        pairs = materialise(tried.where(apart <= max_bits).select(F.least("class1", "hub").alias("a"), F.greatest("class1", "hub").alias("b")).distinct(), "pairs")
        found = materialise(verified(pairs, documents, reps, similarity, width), "links")
        links.append(found)
        both = found.select(F.col("a").alias("class1"), F.col("b").alias("hub")).unionByName(found.select(F.col("b").alias("class1"), F.col("a").alias("hub")))
        left = materialise(tried.join(small_enough(both), ["class1", "hub"], "left_anti").select("key", "class1", "fp0", "fp1", "score"), "variants")
    return links


def across(reps: DataFrame, grouped: DataFrame, similarity: float, least: int) -> DataFrame:
    """a, b: the pairs of classes in different components (grouped: node, component) that share enough of their first shingles to reach the similarity.

    Any partner has at least similarity times as many shingles as a document, so that the pair shares at least `must` of the first ones of both, and one stands among those
    left when each leaves out its must - 1 most frequent ones. How many of the first ones a pair has to share follows from both sizes (`enough`): all that the whole sets have
    to share, less what can stand after the first ones; at most must - 1 of these were left out.
    """
    need = needed(F.col("size"), similarity)
    sized = reps.select("class1", "size", "parity", (need - F.least(F.lit(least), need)).cast("int").alias("after"), F.least(F.lit(least), needed(F.col("size"), similarity * similarity)).cast("int").alias("must"), "prefix")
    rows = sized.select("class1", "size", "after", "must", F.explode("prefix").alias("shingle"))
    counts = materialise(rows.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1"), "first-shingles")
    rows = join_spread(rows.select("class1", "shingle"), counts, ["shingle"])
    rows = rows.join(small_enough(grouped.select(F.col("node").alias("class1"), "component")), "class1", "left").withColumn("component", F.coalesce("component", "class1"))
    rows = materialise(rows, "first-shared")
    mixed = rows.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("held")).where("lo < hi").select("shingle", "held")
    rows = join_spread(rows, materialise(mixed, "first-mixed"), ["shingle"], "held").join(sized.drop("prefix"), "class1")
    own = Window.partitionBy("class1")
    place = F.row_number().over(own.orderBy("n", "shingle"))
    rare = rows.withColumn("place", place).withColumn("own", F.count("*").over(own)).where("place <= own - must + 1")
    rare = materialise(rare.select("shingle", "class1", "component", "size", "after", "must", "parity"), "first-rare")
    left, right = (rare.select("shingle", *[F.col(c).alias(x + n) for c, n in (("class1", ""), ("component", "_of"), ("size", "_size"), ("after", "_after"), ("must", "_must"), ("parity", "_parity"))]) for x in "ab")
    close = F.least("a_size", "b_size") >= F.lit(similarity) * F.greatest("a_size", "b_size") - 1e-9
    # A similar pair has at most this share of both sizes in only one of the sets, so that its parity maps can't differ in more bits.
    apart = sum(F.bit_count(F.get("a_parity", F.lit(k)).bitwiseXOR(F.get("b_parity", F.lit(k)))) for k in range(PARITY))
    close = close & (apart <= F.lit((1 - similarity) / (1 + similarity)) * (F.col("a_size") + F.col("b_size")) + 1e-9)
    enough = F.ceil(F.lit(similarity / (1 + similarity)) * (F.col("a_size") + F.col("b_size")) - 1e-9) - F.greatest("a_after", "b_after")
    pairs = left.join(right, "shingle").where((F.col("a_of") < F.col("b_of")) & close).select("a", "b", enough.alias("enough"), (F.greatest("a_must", "b_must") - 1).alias("out"))
    pairs = materialise(pairs.groupBy("a", "b", "enough", "out").agg(F.count("*").alias("n")).where("n + out >= enough").select("a", "b", "enough"), "pairs")
    wanted = materialise(pairs.select(F.explode(F.array("a", "b")).alias("class1")).distinct(), "wanted")
    firsts = materialise(sized.select("class1", "prefix").join(small_enough(wanted), "class1", "left_semi"), "firsts")
    a, b = (firsts.select(F.col("class1").alias(x), F.col("prefix").alias(f"{x}_first")) for x in "ab")
    return materialise(pairs.join(a, "a").join(b, "b").where(F.size(F.array_intersect("a_first", "b_first")) >= F.col("enough")).select("a", "b"), "pairs")


def near_groups(documents: DataFrame, similarity: float = 0.8, words: int = 5, max_bits: int = 28, rounds: int = 2, least: int = 48) -> DataFrame:
    """doc_id, text_key, first (doc_id and text_key of the first document of the group) of every row with a doc_id."""
    every = materialise(prints(documents, rarity(documents), similarity, words, least), "prints")
    named = every.select("doc_id", "text_key", "class1", "class2")
    classes = materialise(named.groupBy("class1", "class2").agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.count("*").alias("n")), "classes")
    copies = materialise(join_spread(named, classes.where("n > 1"), ["class1", "class2"]).where(F.struct("doc_id", "text_key") != F.col("first")).select("doc_id", "text_key").distinct(), "copies")
    # One row for each class: a repeated row of its first document goes too.
    twice = named.groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1")
    reps = every.join(small_enough(copies), ["doc_id", "text_key"], "left_anti")
    if not twice.isEmpty():
        again = materialise(reps.join(twice, ["doc_id", "text_key"], "left_semi").dropDuplicates(["class1"]), "repeated")
        reps = reps.join(twice, ["doc_id", "text_key"], "left_anti").unionByName(again)
    members = materialise(members_of_variants(reps), "members")
    nothing = members.select(F.col("class1").alias("a"), F.col("class1").alias("b")).where("false")
    edges = nothing
    for found in linked_by_hubs(members, documents, reps, similarity, words, max_bits, rounds):
        edges = edges.unionByName(found)
    grouped = materialise(components(edges), "grouped")
    rest = across(reps, grouped, similarity, least)
    if not rest.isEmpty():
        more = materialise(verified(rest, documents, reps, similarity, words), "links")
        grouped = materialise(components(grouped.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)), "grouped")
    # The first document of each component; only classes that are linked or have copies are looked at again.
    of_class = classes.join(small_enough(grouped), F.col("class1") == F.col("node"), "left").withColumn("component", F.coalesce("component", "class1"))
    linked = materialise(of_class.where("node is not null").groupBy("component").agg(F.min("first").alias("least"), F.count("*").alias("members")), "linked")
    moved = materialise(join_spread(of_class.where("node is not null"), linked, ["component"], "members").select("class1", "class2", F.col("least").alias("first"), "n").unionByName(classes.where("n > 1").join(grouped, F.col("class1") == F.col("node"), "left_anti").select("class1", "class2", "first", "n")), "moved")
    alone = named.join(small_enough(moved.select("class1", "class2")), ["class1", "class2"], "left_anti").withColumn("first", F.struct("doc_id", "text_key"))
    return join_spread(named, moved, ["class1", "class2"]).select("doc_id", "text_key", "first").unionByName(alone.select("doc_id", "text_key", "first"))


def near_copies(documents: DataFrame, **how) -> DataFrame:
    """doc_id, component of every document with a doc_id; component is the smallest doc_id of its group."""
    return near_groups(documents, **how).select("doc_id", F.col("first.doc_id").alias("component"))


def without_near_copies(documents: DataFrame, **how) -> DataFrame:
    """The documents less all but the first of each group of near copies."""
    groups = materialise(near_groups(documents, **how), "groups")
    gone = materialise(groups.where(F.struct("doc_id", "text_key") != F.col("first")).select("doc_id", "text_key").distinct(), "gone")
    own = documents.withColumn("_text_key", F.xxhash64("text"))
    at = (F.col("_text_key") == F.col("text_key"),)
    keys = [x.alias("_doc_id") if k == 0 else x for k, x in enumerate((F.col("doc_id"), F.col("text_key")))]
    kept = own.join(small_enough(gone.select(*keys)), (F.col("doc_id") == F.col("_doc_id")) & at[0], "left_anti")
    twice = materialise(groups.groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1").select(*keys), "twice")
    if not twice.isEmpty():
        same = (F.col("doc_id") == F.col("_doc_id")) & at[0]
        once = kept.join(twice, same, "left_semi").dropDuplicates(["doc_id", "_text_key"])
        kept = kept.join(twice, same, "left_anti").unionByName(once)
    return kept.drop("_text_key")
