"""Mixing sources to target weights.

Tokens are summed per source, targets and repetition rates follow, and each document is taken
floor(rate) times plus one hash-seeded Bernoulli copy with probability equal to the fraction. The draws
of a source are dealt systematically: its documents are put in the order of their size (its five leading
bits), then of a hash of seed and doc_id; with a start u that is a hash of seed and source, the n-th one
gets the copy if floor(n * fraction + u) is more than floor((n - 1) * fraction + u). Every document has
the probability of independent draws, while documents of one size class share the copies evenly: the words
taken miss the target by about the largest document and a few hundredths of the extra words at most.

Draws depend on seed, ids and sizes only, so reruns, retries and other partitionings agree. All of it is
DataFrame operations. The place of a document in its source is the sum of the counts of earlier cells
(source, size class, BUCKETS buckets of the hash) and its place in its own cell, so a hot source is spread
over its cells; the order of the sources and their targets come from sums, without sorting in one task.

Defined results: a null text has size 0; a null source is a source of its own, last in order; a
source without words has rate 0, so its documents are not taken; rows with a null doc_id are drawn by
their text; repeated rows are drawn one by one; a text of any length is counted whole; an empty table
gives an empty result. Columns of the input that are named like computed ones are kept apart, since
the operator works on a struct of the input row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattiq.llm.common import WORD_REGEX, Stash, numbered, table

#: Weights dealt to the sources in order, repeating.
WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix-1"
#: Buckets of the hash in which documents of one source and size class are ranked.
BUCKETS = 256


def word_count(text):
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_REGEX)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target, nth) from rows (source, size); nth numbers the sources by code point.

    Targets share the sum of all sizes by weight; a target above ``cap`` times its source is held there and the
    excess reshared by weight, until none is above. A round of resharing brings two sums to the driver.
    """
    by_source = numbered(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int")).cast("long")
    caps = Stash(by_source.withColumn("w", weight).withColumn("c", F.col("source_size") * cap), "sources").df
    total = caps.agg(F.sum("source_size")).first()[0] or 0
    size, w = total, caps.agg(F.sum("w")).first()[0] or 0
    while True:
        held = F.lit(float(size)) * F.col("w") >= F.col("c").cast("double") * F.lit(float(w))
        sums = caps.agg(F.sum(F.when(held, F.col("c"))).alias("c"), F.sum(F.when(~held, F.col("w"))).alias("w")).first()
        left, w_left = total - (sums["c"] or 0), sums["w"] or 0
        if (left, w_left) == (size, w):
            break
        size, w = left, w_left
    target = F.when(held, F.col("c").cast("double")).otherwise((F.lit(size) * F.col("w")).cast("double") / F.lit(float(w or 1)))
    return caps.select("source", "source_size", target.alias("target"), "nth")


def draw(key, seed: str = SEED):
    """A number in [0, 1) from the first 52 bits of a digest of seed and key."""
    digest = F.md5(F.concat(F.lit(seed + "|"), key).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def size_class(size):
    """The five leading bits of a size, the others 0."""
    more = F.greatest(F.length(F.bin(size)) - 5, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", size, more), more)


def drawn(docs: DataFrame, seed: str = SEED) -> list:
    """What is drawn with: columns size, u and tie of rows (doc_id, source, text)."""
    text = F.coalesce(docs["text"], F.lit(""))
    u = draw(F.coalesce(docs["doc_id"].cast("string"), F.concat(F.lit("text "), text)), seed)
    return [word_count(docs["text"]).alias("size"), u.alias("u"), F.xxhash64(text).alias("tie")]


def copies(rows: DataFrame, targets: DataFrame, seed: str = SEED) -> DataFrame:
    """Rows (doc_id, source, size, u, tie, ...) with source_size, target and copies."""
    known = targets.withColumn("v", draw(F.coalesce("source", F.lit("null")), seed + "|source")).withColumnRenamed("source", "s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size"))).otherwise(0.0)
    rows = rows.join(known, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("rate", rate)
    rows = rows.withColumn("class", size_class(F.col("size"))).withColumn("bucket", F.floor(F.col("u") * BUCKETS).cast("int"))
    cell = ["nth", "class", "bucket"]
    before = F.sum("n").over(Window.partitionBy("nth").orderBy("class", "bucket").rowsBetween(Window.unboundedPreceding, -1))
    cells = rows.groupBy(*cell).agg(F.count("*").alias("n")).select(*cell, F.coalesce(before, F.lit(0)).alias("before"))
    mine = F.row_number().over(Window.partitionBy(*cell).orderBy("u", F.col("doc_id").asc_nulls_first(), "size", "tie"))
    n, f = F.col("before") + F.col("mine"), F.col("rate") - F.floor("rate")
    extra = F.floor(n * f + F.col("v")) - F.floor((n - 1) * f + F.col("v"))
    return rows.withColumn("mine", mine).join(cells, cell).withColumn("copies", F.floor("rate") + extra)


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The mixed corpus: every row as often as the mix takes it, with the columns of ``docs``."""
    targets = source_targets(docs.select("source", word_count(docs["text"]).alias("size")), weights, cap)
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), "doc_id", "source", *drawn(docs, seed))
    taken = copies(rows, targets, seed).where("copies > 0")
    return taken.select(F.explode(F.array_repeat("row", F.col("copies").cast("int"))).alias("row")).select("row.*")


def mix_counts(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every row; the texts are read once."""
    rows = Stash(docs.select("doc_id", "source", *drawn(docs, seed)), "sizes").df
    plan = copies(rows, source_targets(rows.select("source", "size"), weights, cap), seed)
    return plan.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_counts(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("source")


OP10_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST(CAST('0x' || substr(md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), 'text ' || coalesce(text, ''))), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
  FROM documents
), by_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source
), caps AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w,
    source_size * 3 AS c FROM by_source
), steps AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(c) OVER b, 0) AS DOUBLE) * w
    >= CAST(c AS DOUBLE) * CAST(sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS DOUBLE) AS held
  FROM caps WINDOW b AS (ORDER BY c / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size, CASE WHEN held THEN CAST(c AS DOUBLE) ELSE
    CAST(CAST((sum(source_size) OVER () - sum(CASE WHEN held THEN c ELSE 0 END) OVER ()) * w AS BIGINT) AS DOUBLE)
    / CAST(sum(CASE WHEN held THEN 0 ELSE w END) OVER () AS DOUBLE) END AS target
  FROM steps
), rates AS (
  SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    CAST(CAST('0x' || substr(md5('mix-1|source|' || coalesce(d.source, 'null')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS v
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), places AS (
  SELECT *, rate - floor(rate) AS f, row_number() OVER (PARTITION BY source
    ORDER BY (size >> greatest(len(bin(size)) - 5, 0)) << greatest(len(bin(size)) - 5, 0), u, doc_id NULLS FIRST, size) AS n
  FROM rates
)
SELECT doc_id, size, source_size, target,
  CAST(size * (CAST(floor(rate) AS BIGINT) + CAST(floor(n * f + v) - floor((n - 1) * f + v) AS BIGINT)) AS BIGINT) AS taken
FROM places
"""
