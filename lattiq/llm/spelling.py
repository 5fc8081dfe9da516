"""Spelling variants: words that differ by one code point, grouped towards the most frequent form.

A rare-first prefix filter over bigrams finds the pairs. One edit touches at most two bigrams of either word. So if
the bigrams of every word are ordered by how many words of the vocabulary have them, rarest first, and by their place
among equal ones, then of the three first bigrams of each word at least one is the same undamaged bigram in both.
(The order is by the bigram alone, since an edit can shift its place; the place limits the join.) A replaced code
point leaves all places, an inserted one moves those behind it by one. And of the two halves of the shorter word one
is as it was. The join is therefore an equality of bigram, half and length, for equal lengths also of the place, and
each word is asked for at its own length and at one more. Candidates are verified by their edit distance.

Everything is DataFrame operations: words are counted with partial sums in every task, so that a word in all documents
is no hot key; the order of bigrams is a table of at most 90 x 90 rows, whatever the corpus. It alone is broadcast: all
other joins are of tables that grow with the vocabulary, which Parquet makes look small enough to be gathered in the
driver, so they are sorted and merged. Roots are found by
following forms in doubled steps; a form is at least twice as frequent as its word, so a chain has no more links
than the count of the most frequent word has bits.

Defined results: null and empty texts have no words; a null doc_id counts as the empty text; repeated rows count each
time; of equally frequent near words the smallest in code-point order is the form; texts of any length are read whole; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.llm.common import Stash, table

LETTERS = "[A-Za-zÀ-ÿ]+"
MIN_LENGTH, MIN_COUNT, TYPO = 5, 3, 97
#: Bigrams of a word that are joined: one more than an edit can touch.
PREFIX = 3


def spelled(docs: DataFrame, typo: int = TYPO) -> DataFrame:
    """(word), once for each occurrence: lower-cased runs of letters; where ``typo`` divides the checksum of document and
    run, the run lacks one code point."""
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(LETTERS), F.lit(0))).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return runs.select(F.when(F.col("h") % typo == 0, shorter).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame, typo: int = TYPO, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    words = spelled(docs, typo).where(F.length("word") >= min_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def bigrams(word: Column) -> Column:
    """Array of (gram, at), ``at`` being the place from 0 on."""
    return F.transform(F.sequence(F.lit(0), F.length(word) - 2), lambda i: F.struct(F.substring(word, i + 1, F.lit(2)).alias("gram"), i.alias("at")))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b): the pairs of words that differ by exactly one inserted, deleted or replaced code point, each once, the shorter
    one (of equal lengths the smaller one) first. ``words`` has distinct words of four code points at least."""
    every = words.select("word", F.explode(bigrams(F.col("word"))).alias("g"))
    order = every.select("word", "g.gram").distinct().groupBy("gram").agg(F.count("*").alias("words"))
    first = every.select("word", "g.gram", "g.at").join(F.broadcast(order), "gram")
    rare = first.groupBy("word").agg(F.slice(F.array_sort(F.collect_list(F.struct("words", "gram", "at"))), 1, PREFIX).alias("p"))
    rare = rare.select("word", F.explode("p").alias("p")).select("word", "p.gram", "p.at")
    word, n = F.col("word"), F.length("word")

    def halves(role: str, size: Column, place: Column) -> list[Column]:
        """Keys for a pair whose shorter word has ``size`` code points: by what is before its middle, and behind it."""
        k = F.floor(size / 2).cast("int")
        parts = (F.substring(word, F.lit(1), k), F.substring(word, n - (size - k) + 1, size - k))
        return [F.xxhash64(F.lit(f"{role}{i}"), "gram", size, part, place) for i, part in enumerate(parts)]

    any_place = F.lit(-1)
    same = halves("same", n, F.col("at"))
    left = rare.select(F.col("word").alias("a"), F.col("at").alias("place"), F.explode(F.array(*same, *halves("one", n, any_place))).alias("key"))
    right = rare.select(F.col("word").alias("b"), "at", F.explode(F.array(*same, *halves("one", n - 1, any_place))).alias("key"))
    longer, moved = F.length("b") - F.length("a"), F.col("at") - F.col("place")
    near = ((longer == 0) & (F.col("a") < F.col("b"))) | ((longer == 1) & moved.between(0, 1))
    return left.join(right.hint("merge"), "key").where(near).where(F.levenshtein("a", "b", 1) == 1).select("a", "b").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): the last word that the forms lead to, in doubled steps."""
    now = Stash(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        nxt = now.df.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = Stash(now.df.join(nxt.hint("merge"), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "forms")
        now.drop()
        now = after
        if not now.df.where("moved").take(1):
            return now.df.select("word", "root")


def variants(docs: DataFrame, typo: int = TYPO, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word; see the module's description."""
    words = Stash(vocabulary(docs, typo, min_length, min_count), "words").df
    pairs = near_pairs(words.select("word"))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).union(pairs.select("b", "a"))
    counted = both.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")).hint("merge"), "near")
    best = counted.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    of = words.join(best.hint("merge"), "word", "left")
    enough = -F.col("best.less") >= 2 * F.col("n")
    out = Stash(of.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")), "variants").df
    ends = roots(out.where("form IS NOT NULL"))
    return out.join(ends.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
