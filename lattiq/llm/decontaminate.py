"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame operations only.

Words are runs of letters and digits of the lower-cased text; shingles are WORDS words in a row, weighted
by how often they occur. A window has as many shingles as the items of one size. Of a window that is similar
enough to an item, at least the level's share of an item's size are shingles of the item, wherever they stand in either. So
the places in a document that hold a shingle of items of one size are numbered, each is joined to the one that
makes the count full, and where these lie in one window's width every start that covers both is taken: all
windows that can reach the level, in whatever order an item's passages come. Each window gets a 64-bit SimHash.
The items' fingerprints are indexed by BLOCKS blocks, each with all values within BLOCK_RADIUS bits of it; a
fingerprint within RADIUS bits agrees with a listed value in one block at least, so the index finds all of them.
Candidates are verified by the exact weighted Jaccard similarity of their shingles.

RADIUS is 19. Sets of similarity 0.8 differ in 9.7 of the 64 bits on average, with a deviation of 2.9, so that a
window at the level itself is missed with a probability below 1 in 1,000, one at 0.85 below 1 in
20,000; a random window meets about a fifth of the items of its size in the index (71 % with the
blocks of 8 bits and radius 2 that a RADIUS of 23 takes).

Windows are rows, one for all windows of a document that hold the same shingles in the same order; their shingles come
from the document's in parts of PART, so that no row holds more than a window or a document. The
benchmark's side of a join is broadcast only if that side itself is counted to have at most BROADCAST_ROWS
rows; else the joins shuffle.

Defined results: null texts, texts and items without words match nothing; texts and items of fewer than
WORDS words have one shingle, all of it; a window that runs over an end of the text is cut there; rows
with a null doc_id or null item_id are not searched; repeated rows give their matches once, and rows that
repeat an id with other texts are all searched; of equally similar windows the first counts; a text of any
length is searched whole; empty tables give an empty result; further columns are ignored by ``leaks`` and
kept by ``clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattiq.llm.common import Stash, table

WORDS, LEVEL = 5, 0.8
#: The last block has the 12 bits that are left.
BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 5, 13, 3
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
BROADCAST_ROWS = 500_000
#: Shingles of a document that are joined to windows as one array.
PART = 512


def shingles(text: Column, words: int = WORDS) -> Column:
    """Array of shingle hashes in text order."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))

    def of(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(w) - words), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(words)]))
        short = F.when(F.size(w) > 0, F.array(F.xxhash64(F.concat_ws(" ", w)))).otherwise(F.array().cast("array<bigint>"))
        return F.when(F.size(w) >= words, each).otherwise(short)

    return F.get(F.transform(F.array(found), of), F.lit(0))  # the words are found once, not once a shingle


def simhash(hashes: Column) -> Column:
    """Bit b is set if, of all hashes with their repeats, most have it set."""
    one = F.lit(1).cast("long")

    def bit(b: Column) -> Column:
        votes = F.aggregate(hashes, F.lit(0), lambda acc, h: acc + F.getbit(h, b).cast("int") * 2 - 1)
        return F.when(votes > 0, F.call_function("shiftleft", one, b)).otherwise(F.lit(0).cast("long"))

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), bit), F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x))


def block(fingerprint: Column, k: Column) -> Column:
    return F.call_function("shiftrightunsigned", fingerprint, k * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")


def repeated(s: Column) -> Column:
    """The distinct values that an array holds more than once."""
    some = F.array_distinct(F.filter(s, lambda x, i: F.array_position(s, x) != i + 1))
    return F.when(F.size(F.array_distinct(s)) < F.size(s), some).otherwise(F.array().cast("array<bigint>"))


def weighted_jaccard(a: Column, b: Column, more_a: Column, more_b: Column) -> Column:
    """Of two arrays with repeats; ``more_a`` and ``more_b`` are their repeated values."""
    times = lambda s, x: F.size(F.filter(s, lambda y: y == x))
    again = F.aggregate(F.array_intersect(more_a, more_b), F.lit(0), lambda acc, x: acc + F.least(times(a, x), times(b, x)) - 1)
    both = F.size(F.array_intersect(a, b)) + again
    return both / (F.size(a) + F.size(b) - both)


def leaks(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, level: float = LEVEL, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, item_id, start, similarity): the best window of each pair that reaches the level."""
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), shingles(F.col("text"), words).alias("t"))
    items = items.where(F.size("t") > 0).distinct().select("item_id", "t", repeated(F.col("t")).alias("more_t"), F.size("t").alias("m"), simhash(F.col("t")).alias("fp"))
    items = Stash(items, "items").df
    masks = [x for x in range(1 << BLOCK_BITS) if x.bit_count() <= BLOCK_RADIUS]
    size = items.agg(F.sum("m").alias("shingles"), F.count("*").alias("items")).first()

    def side(df: DataFrame, rows: int) -> DataFrame:
        return F.broadcast(df) if rows <= broadcast_rows else df

    key = ["doc_id", "version"]  # rows may repeat an id with other texts
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), "text")
    anchors = items.select("m", F.explode("t").alias("h")).distinct()
    at = texts.select(*key, F.posexplode(shingles(F.col("text"), words)).alias("pos", "h"))
    hits = at.join(side(anchors, size["shingles"] or 0), "h").select(*key, "m", "pos")
    hits = Stash(hits.withColumn("nth", F.dense_rank().over(Window.partitionBy(*key, "m").orderBy("pos"))), "hits").df
    need = F.ceil(F.col("m") * level - 1e-9).cast("int")  # also of a window that an end of the text cuts
    full = hits.select(*key, "m", "pos", (F.col("nth") + need - 1).alias("nth")).join(hits.withColumnRenamed("pos", "far"), [*key, "m", "nth"]).where(F.col("far") < F.col("pos") + F.col("m"))
    starts = Stash(full.select(*key, "m", F.explode(F.sequence(F.col("far") - F.col("m") + 1, "pos")).alias("start")).distinct(), "starts").df

    # a row for each window; of windows of a document with the same shingles, the first
    part = lambda x: F.floor(x / PART).cast("int")
    spans = starts.select("*", F.explode(F.sequence(part(F.greatest("start", F.lit(0))), part(F.col("start") + F.col("m") - 1))).alias("part"))
    wanted = spans.groupBy(*key).agg(F.collect_set("part").alias("parts"))
    held = texts.hint("merge").join(wanted, key).select(*key, "parts", shingles(F.col("text"), words).alias("s"))
    held = held.select(*key, F.explode(F.transform("parts", lambda p: F.struct(p.alias("part"), F.slice("s", p * PART + 1, PART).alias("s")))).alias("p")).select(*key, "p.part", "p.s")
    low, high = F.greatest("start", F.col("part") * PART), F.least(F.col("start") + F.col("m"), (F.col("part") + 1) * PART)
    cut = spans.join(held, [*key, "part"]).select(*key, "m", "start", F.struct("part", F.slice("s", low - F.col("part") * PART + 1, high - low).alias("s")).alias("p"))
    w = cut.groupBy(*key, "m", "start").agg(F.flatten(F.transform(F.array_sort(F.collect_set("p")), lambda p: p["s"])).alias("s"))
    first = w.groupBy("doc_id", "m", F.xxhash64("s").alias("content")).agg(F.min(F.struct("start", "s")).alias("b"))
    windows = first.select("doc_id", "m", "b.start", "b.s").select("*", repeated(F.col("s")).alias("more_s"), simhash(F.col("s")).alias("fp"))
    windows = Stash(windows, "windows").df

    every = F.sequence(F.lit(0), F.lit(BLOCKS - 1))
    index = items.withColumn("k", F.explode(every)).withColumn("mask", F.explode(F.array(*map(F.lit, masks))))
    index = index.select("item_id", "m", "k", block(F.col("fp"), F.col("k")).bitwiseXOR(F.col("mask")).alias("value"), F.col("fp").alias("item_fp"))
    probes = windows.select("doc_id", "m", "start", "fp", F.explode(every).alias("k")).withColumn("value", block(F.col("fp"), F.col("k")))
    near = probes.join(side(index, size["items"] * BLOCKS * len(masks)), ["m", "k", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
    near = near.select("doc_id", "m", "start", "item_id").distinct()
    found = near.join(windows.select("doc_id", "m", "start", "s", "more_s"), ["doc_id", "m", "start"]).join(side(items.select("item_id", "m", "t", "more_t"), size["shingles"] or 0), ["item_id", "m"])
    found = found.withColumn("similarity", weighted_jaccard(F.col("s"), F.col("t"), F.col("more_s"), F.col("more_t"))).where(F.col("similarity") >= level)
    best = F.max(F.struct("similarity", -F.col("start"))).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", (-F.col("best.col2")).cast("long").alias("start"), F.col("best.similarity").alias("similarity"))


def clean(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, level: float = LEVEL) -> DataFrame:
    """The rows of ``docs`` without those that hold a benchmark item."""
    bad = leaks(docs, benchmark, words, level).select(F.col("doc_id").alias("bad")).distinct()
    return docs.join(bad, docs["doc_id"] == bad["bad"], "left_anti")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
