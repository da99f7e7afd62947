"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

Each mask picks some of the tokens from a position on and ignores the others. The hashes of what the masks pick are joined between test items and documents; around
every hit the windows of aligned tokens that hold it are compared, and a window of which at least min_match tokens are equal reports the pair. Substituted tokens thus neither
hide a passage from all masks nor from the comparison. Items of fewer than min_words tokens are found where all of their tokens stand in a row.

Items of one text are searched once, and its hits are theirs. Bare hashes and places of the texts go to every worker while these have at most max_broadcast_words words, and apart from them
each text once; beyond that bare positions and hashes meet in a shuffle join (each seed in `salts` tasks), and only the tokens around a hit are fetched. Either way a hit is a row with these tokens.

Null and empty texts have no hit; items without a token are left out. Rows without doc_id are searched and reported without one; repeated rows report the same pair
once, with the hits of all. Very long texts are searched whole. Of windows that tie the first counts. Empty tables give an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.shared import materialise, small_enough

# Positions that each mask keeps, from the first token on.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 3, 4, 5), (0, 1, 4, 6, 7))
WINDOW = 16


def tokens(text: Column) -> Column:
    """Runs of letters and digits, in lower case; ends may give an empty token, which matches nothing but another."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")


def seeds(rows: DataFrame, masks: tuple[tuple[int, ...], ...]) -> DataFrame:
    """rows (with the array `words`) once for each position and mask: position `at` and `seed`, null where the mask reaches past the end.

    Exploding first and then picking neighbours from the array keeps all of it in generated code, which a lambda over the array would not be. The outer form of
    explode keeps the optimizer from splitting texts a second time to see whether they are empty; they never are.
    """
    at = rows.select("*", F.posexplode_outer("words").alias("at", "_word")).drop("_word")
    picked = [F.when(F.col("at") + max(keep) < F.size("words"), F.xxhash64(F.lit(m), *[F.get("words", F.col("at") + k) for k in keep])) for m, keep in enumerate(masks)]
    return at.select("*", F.explode(F.array(*picked)).alias("seed"))


def keyed(documents: DataFrame) -> DataFrame:
    """doc_id, doc_key (of the text, which tells rows of one doc_id apart) and words of every row."""
    return documents.select("doc_id", F.xxhash64("text").alias("doc_key"), tokens(F.col("text")).alias("words"))


def near(words: Column | str, at: Column | str, reach: int) -> Column:
    """The tokens from `reach` before to `reach` behind a place."""
    at = F.col(at) if isinstance(at, str) else at
    return F.slice(words, F.greatest(F.lit(1), at - reach + 1), F.least(at, F.lit(reach)) + reach + 1)


def distinct_texts(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ref, words) of every different text of the items, and (ref, item_id, copies) of the items that have it."""
    rows = benchmark.where("text is not null").groupBy("item_id", "text").agg(F.count("*").alias("copies"))
    refs = materialise(rows.select("text").distinct().withColumn("ref", F.monotonically_increasing_id()), "item-texts")
    owners = materialise(rows.join(refs.hint("shuffle_merge"), "text").select("ref", "item_id", "copies"), "item-owners")
    return materialise(refs.select("ref", tokens(F.col("text")).alias("words")), "item-words"), owners


def seed_hits(documents: DataFrame, texts: DataFrame, masks: tuple[tuple[int, ...], ...], reach: int, salts: int, few: int = 100_000) -> DataFrame:
    """doc_id, ref, at, j of every hit, the document's tokens around it, and how many it has; by a shuffle join of bare seeds."""
    at = seeds(documents, masks).where("seed is not null").select("doc_id", "doc_key", "at", "seed", F.pmod(F.hash("doc_key", "at"), F.lit(salts)).alias("salt"))
    tested = seeds(texts, masks).where("seed is not null").select("ref", F.col("at").alias("j"), "seed", F.explode(F.array(*map(F.lit, range(salts)))).alias("salt"))
    # Repeated rows come back from the fetch as often as they are there, so that each hit is kept once for them and counts the masks that found it: their seeds differ.
    found = at.join(tested.hint("shuffle_merge"), ["seed", "salt"]).groupBy("doc_id", "doc_key", "at", "ref", "j").agg(F.size(F.collect_set("seed")).alias("times"))
    hits = materialise(found, "seed-hits")
    rows = documents.select(F.col("doc_id").alias("_doc_id"), F.col("doc_key").alias("_doc_key"), F.col("words").alias("_words"))
    # Files of hits compress well, so that Spark would take millions of them for few.
    joined = small_enough(hits, few).join(rows.hint("shuffle_merge"), F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("doc_key") == F.col("_doc_key")))
    return joined.select("doc_id", "ref", "at", "j", "times", near("_words", "at", reach).alias("words"), F.size("_words").alias("words_size"))


def contaminated(documents: DataFrame, benchmark: DataFrame, masks: tuple[tuple[int, ...], ...] = MASKS, window: int = WINDOW, min_match: float = 0.8, min_words: int = 8, max_broadcast_words: int = 500_000, salts: int = 8) -> DataFrame:
    """doc_id, item_id, n_hits, first_word, similarity (of the best window) for each document that holds a passage of an item."""
    texts, owners = distinct_texts(benchmark)
    long = texts.where(F.size("words") >= min_words)
    total = long.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    reach = window - 1
    if total <= max_broadcast_words:
        tested = seeds(long, masks).where("seed is not null").select("ref", F.col("at").alias("j"), "seed")
        hits = seeds(documents.select("doc_id", tokens(F.col("text")).alias("words")), masks).join(F.broadcast(tested), "seed")
        hits = hits.select("doc_id", "ref", "at", "j", F.lit(1).alias("times"), near("words", "at", reach).alias("words"), F.size("words").alias("words_size"))
        around = F.broadcast(long.withColumnRenamed("words", "_item"))
    else:
        hits = seed_hits(keyed(documents), long, masks, reach, salts)
        around = small_enough(long.withColumnRenamed("words", "_item"), 20_000)
    hits = hits.join(around, "ref").select(*hits.columns, near("_item", "j", reach).alias("item"), F.size("_item").alias("item_size"))
    hits = hits.withColumns({"words_from": F.greatest(F.lit(0), F.col("at") - reach), "item_from": F.greatest(F.lit(0), F.col("j") - reach)})
    # Item position p lies beside document position p + at - j: both exist from lo to before hi.
    lo, hi = "greatest(0, j - at)", "least(item_size, words_size - at + j)"
    hits = hits.withColumn("size", F.expr(f"least({window}, {hi} - {lo})"))
    hits = hits.withColumn("start", F.expr(f"greatest({lo}, j - {window - 1})")).withColumn("span", F.expr(f"least({hi}, j + {window}) - start"))
    same = "zip_with(slice(item, start - item_from + 1, span), slice(words, start + at - j - words_from + 1, span), (x, y) -> x = y)"
    # The most equal words of any window in the span, and how far into it the first such window begins.
    best = F.expr(f"array_max(transform(array({same}), s -> array_max(transform(sequence(0, span - size), k -> struct(size(filter(slice(s, k + 1, size), e -> e)) as n, -k as k)))))")
    # The comparison stands in a generator, which no filter passes: inside the join's condition its lambda would take the join out of generated code.
    compared = hits.where(F.col("size") >= min_words).select("doc_id", "ref", "start", "at", "j", "size", "times", F.explode(F.array(best)).alias("best"))
    compared = compared.select("doc_id", "ref", (F.col("start") - F.col("best.k") + F.col("at") - F.col("j")).alias("first"), "times", (F.col("best.n") / F.col("size")).alias("similarity"))
    found = compared.where(F.col("similarity") >= min_match)
    short = texts.withColumn("words", F.filter("words", lambda w: w != "")).where((F.size("words") < min_words) & (F.size("words") > 0))
    lengths = sorted(r[0] for r in short.select(F.size("words")).distinct().collect())
    if lengths:
        found = found.unionByName(whole_hits(documents, short, tuple(lengths)))
    found = found.groupBy("doc_id", "ref").agg(F.sum("times").alias("times"), F.min("first").cast("long").alias("first"), F.max("similarity").alias("similarity"))
    of_items = found.join(small_enough(owners), "ref")
    return of_items.groupBy("doc_id", "item_id").agg(F.sum(F.col("times") * F.col("copies")).alias("n_hits"), F.min("first").alias("first_word"), F.max("similarity").alias("similarity"))


def whole_hits(documents: DataFrame, short: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """Places where all words of a short item stand in a row; lengths are those of the items, fewer than min_words of them."""
    masks = tuple(tuple(range(n)) for n in lengths)
    tested = short.select("ref", F.col("words").alias("item"), F.explode(F.array(*[F.when(F.size("words") == n, F.xxhash64(F.lit(m), *[F.get("words", F.lit(k)) for k in range(n)])) for m, n in enumerate(lengths)])).alias("seed"))
    tested = materialise(tested.where("seed is not null"), "short-items")
    # A row holds the few words that an item can have, so that it may be shuffled.
    behind = F.slice("words", F.col("at") + 1, max(lengths)).alias("behind")
    hits = seeds(documents.select("doc_id", tokens(F.col("text")).alias("words")), masks).where("seed is not null").select("doc_id", "at", "seed", behind)
    hits = hits.join(small_enough(tested, 100_000), "seed").where("slice(behind, 1, size(item)) = item")
    return hits.select("doc_id", "ref", F.col("at").alias("first"), F.lit(1).alias("times"), F.lit(1.0).alias("similarity"))


def op7_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+') AS h FROM documents),
b AS (SELECT item_id, regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+') AS h FROM benchmark),
m AS (SELECT * FROM (VALUES (0, [0, 1, 2, 3, 4]), (1, [0, 1, 3, 4, 5]), (2, [0, 1, 4, 6, 7])) AS t(mask, keep)),
ds AS (SELECT doc_id, h, pos, mask, array_to_string(list_transform(keep, lambda k: h[pos + k + 1]), ' ') AS seed
       FROM (SELECT *, unnest(range(len(h))) AS pos FROM d), m WHERE pos + keep[-1] < len(h)),
bs AS (SELECT item_id, h AS item, j, mask, array_to_string(list_transform(keep, lambda k: h[j + k + 1]), ' ') AS seed
       FROM (SELECT *, unnest(range(len(h))) AS j FROM b WHERE len(h) >= 8), m WHERE j + keep[-1] < len(h)),
x AS (SELECT *, greatest(0, j - pos) AS lo, least(len(item), len(h) - pos + j) AS hi FROM ds JOIN bs USING (mask, seed)),
y AS (SELECT *, row_number() OVER () AS hit, least(16, hi - lo) AS size FROM x WHERE least(16, hi - lo) >= 8),
w AS (SELECT hit, doc_id, item_id, pos - j AS shift, size, start,
             len(list_filter(range(size), lambda k: item[start + k + 1] = h[start + pos - j + k + 1])) AS n
      FROM (SELECT *, unnest(range(greatest(lo, j - 15), least(hi, j + 16) - size + 1)) AS start FROM y)),
z AS (SELECT hit, doc_id, item_id, max(n) / any_value(size) AS similarity, arg_min(start + shift, (-n, start)) AS first FROM w GROUP BY hit, doc_id, item_id),
s AS (SELECT doc_id, item_id, pos AS first FROM (SELECT *, unnest(range(len(h))) AS pos FROM d),
      (SELECT item_id, list_filter(h, lambda x: x <> '') AS item FROM b) WHERE len(item) BETWEEN 1 AND 7 AND h[pos + 1 : pos + len(item)] = item)
SELECT doc_id, item_id, count(*) AS n_hits, min(first) AS first_word, max(similarity) AS similarity
FROM (SELECT doc_id, item_id, first, similarity FROM z WHERE similarity >= 0.8 UNION ALL SELECT doc_id, item_id, first, 1.0 FROM s) GROUP BY doc_id, item_id
"""
