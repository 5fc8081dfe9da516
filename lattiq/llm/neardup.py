"""MinHash near-duplicates by one-permutation hashing.

1. One pass makes each document's set of distinct word shingles (64-bit hashes), its size and two
   digests. Documents with equal sets form a class, represented by its smallest doc_id.
2. Classes get a one-permutation signature of BANDS * ROWS bins; empty bins borrow from a bin drawn by
   a hash of bin and attempt (optimal densification). Bands of ROWS bins are bucket keys.
3. A bucket gives a star: one candidate edge from its smallest member to each other one, so pairs grow
   with the members, not with their square. Components of the star edges are families: two sets
   that share a bucket are in one family, whichever was the centre.
4. Links are confirmed within families on full sets, in two rounds over blocks of BLOCK members. The first
   is a star of blocks: a task compares one block, and the family's first block, with all of both, so rows sent
   and pairs compared grow with the family, not with its square. A family that these links join is settled.
   In another, members of its largest component so far need no further comparison with each other; every
   other pair of blocks is a task of the second round. Tasks return a spanning star, never all links. So what is
   compared is members times those outside the largest component: quadratic only in families that fall apart.
5. Components of the confirmed links, joined back to all members of the classes.

At the link threshold a band agrees with probability 0.85 ** 6, so that all 56 bands miss has
probability below 1e-11 (short sets with few distinct bins: about 1e-6). At the level 80 of the
pipeline's stage it is 0.8 ** 6, and the probability of a miss is 4e-8.

Defined results: null or word-less texts have the empty set, link with nothing and are kept; rows with
a null doc_id link with nothing, have a null component and are kept; rows that repeat a doc_id count as
one document, which links with whatever any of its texts links with; a text of any length is read whole; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.llm.common import Stash, arrow_map, mix64, pieces, raw_text, span_hashes, table
from lattiq.llm.graph import components, smallest_reachable

WORDS, LEVEL = 5, 85
ROWS, BANDS, BLOCK = 6, 56, 384
BINS = ROWS * BANDS
_EMPTY = np.uint32(0xFFFFFFFF)


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, in a row, and the offsets of each text's."""
    offsets = offsets - offsets[0]
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    low = np.where((data >= 65) & (data <= 90), data + 32, data)
    inside = (low != 32) & ((low < 9) | (low > 13))
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    b = np.flatnonzero(inside & (first[:-1] | np.concatenate([[True], ~inside[:-1]])))
    e = np.flatnonzero(inside & (first[1:] | np.concatenate([~inside[1:], [True]]))) + 1
    word = span_hashes(low, b, e)
    row = np.searchsorted(offsets, b, "right") - 1
    count = np.bincount(row, minlength=n)
    start = np.cumsum(count) - count
    whole = np.maximum(count - words + 1, (count > 0).astype(np.int64))
    of = np.repeat(np.arange(n), whole)
    at = start[of] + np.arange(len(of)) - np.repeat(np.cumsum(whole) - whole, whole)
    h = np.zeros(len(of), np.uint64)
    for k in range(words):
        has = k < count[of]
        h = np.where(has, mix64(h * np.uint64(31) + word[np.minimum(at + k, len(word) - 1)]), h)
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    h, of = h[fresh], of[fresh]
    return h, np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))])


def signatures(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One-permutation signatures (rows, BINS) of sets; empty sets have no defined one."""
    n = len(offsets) - 1
    of = np.repeat(np.arange(n), np.diff(offsets))
    sig = np.full(n * BINS, _EMPTY, np.uint32)
    mixed = mix64(h ^ np.uint64(0x5851F42D4C957F2D))
    where = ((mixed >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    np.minimum.at(sig, of * BINS + where, np.minimum(mixed.astype(np.uint32), _EMPTY - np.uint32(1)))
    sig = sig.reshape(n, BINS)
    empty = sig == _EMPTY
    filled = ~empty
    r, c = np.nonzero(empty & filled.any(1)[:, None])
    attempt = 0
    while len(r):
        attempt += 1
        if attempt < 4 * BINS:
            donor = (mix64(c.astype(np.uint64) + np.uint64(attempt << 20)) % np.uint64(BINS)).astype(np.int64)
        else:
            donor = (c + attempt) % BINS
        ok = filled[r, donor]
        sig[r[ok], c[ok]] = sig[r[ok], donor[ok]]
        r, c = r[~ok], c[~ok]
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(rows, BANDS) bucket keys; the band is part of the key."""
    parts = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(sig), BANDS)).copy()
    for k in range(ROWS):
        key = mix64(key * np.uint64(31) + parts[:, :, k] + np.uint64(1))
    return key


def shared_counts(left: list[np.ndarray], right: list[np.ndarray] | None, part: int = 4096) -> np.ndarray:
    """Sizes of the intersections of every set of ``left`` with every one of ``right`` (or every other of left), by
    products of 0/1 matrices over ``part`` shingles at a time; a shingle of one set only is left out."""
    every = left + (right or [])
    of = np.repeat(np.arange(len(every)), [len(x) for x in every])
    _, column, times = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
    some = times[column] > 1
    of, column = of[some], column[some]
    by = np.argsort(column, kind="stable")
    of, column = of[by], column[by]
    column = np.cumsum(np.append(0, column[1:] != column[:-1])) if len(column) else column
    first = 0 if right is None else len(left)
    out = np.zeros((len(left), len(every) - first), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, part):
        mine = slice(*np.searchsorted(column, [at, at + part]))
        has = np.zeros((len(every), part), np.float32)
        has[of[mine], column[mine] - at] = 1
        out += has[: len(left)] @ has[first:].T
    return out


def confirm(left: list[np.ndarray], right: list[np.ndarray] | None, level: int = LEVEL) -> list[tuple[int, int]]:
    """A spanning forest, as pairs of positions, of the components of the links among ``left`` (or left and right).

    Every pair of sets is compared exactly, at every size."""
    other = left if right is None else right
    m, n = len(left), len(left) + len(right or [])
    sizes, others = (np.array([len(x) for x in y]) for y in (left, other))
    both = shared_counts(left, right).astype(np.int64)
    i, j = np.nonzero(100 * both >= level * (sizes[:, None] + others[None, :] - both))
    root = smallest_reachable(n, i, j if right is None else j + m)
    return [(a, int(root[a])) for a in np.flatnonzero(root != np.arange(n)).tolist()]


# ---------------------------------------------------------------- over Spark


def digests(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, n, d1, d2, keys): size, two digests and bucket keys of every row's set."""

    def rows(batches):
        for batch in batches:
            data, offsets = raw_text(batch.column("text"))
            for lo, hi in pieces(offsets):
                h, at = shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1], words)
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(h ^ np.uint64(salt)))]) for salt in (0x51, 0xA7)]
                d1, d2 = ((s[at[1:]] - s[at[:-1]]).view(np.int64) for s in sums)
                n = np.diff(at)
                keys = band_keys(signatures(h, at)).view(np.int64)
                cut = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cut), pa.array(keys[n > 0].ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(n), pa.array(d1), pa.array(d2), lists], names=["doc_id", "n", "d1", "d2", "keys"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rows, "doc_id long, n long, d1 long, d2 long, keys array<long>")


def families(reps: DataFrame) -> DataFrame:
    """(id, family) of the classes that share a bucket with another, from (rep, keys)."""
    rows = reps.select("rep", F.explode("keys").alias("key"))
    centres = rows.groupBy("key").agg(F.min("rep").alias("centre"), F.count("*").alias("k")).where("k > 1").select("key", "centre")
    stars = rows.join(centres, "key").where("rep <> centre").select(F.col("centre").alias("a"), F.col("rep").alias("b"))
    return components(stars, "stars").select("id", F.col("component").alias("family"))


def member_sets(docs: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """The members (id, family, blocks, places) with the set of each of their texts as ``shingles``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    columns = ["id", "family", "blocks", "places"]
    rows = texts.hint("merge").join(members, "id").select(*columns, "text")  # one plan at every size

    def sets(batches):
        for batch in batches:
            data, offsets = raw_text(batch.column("text"))
            for lo, hi in pieces(offsets):
                h, at = shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1], words)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(lo, hi - lo) for k in columns], lists], names=[*columns, "shingles"])

    return arrow_map(rows, sets, "id long, family long, blocks int, places array<struct<lo:int,hi:int,side:int>>, shingles array<long>")


def compared(made: DataFrame, level: int) -> DataFrame:
    """(a, b): spanning links of what each task compares on full sets.

    ``made``: (family, places, id, shingles), places being an array of (lo, hi, side). A task (family, lo, hi) compares
    its rows of side 0 with those of side 1 and, where it has one side only, with each other."""
    tiles = made.withColumn("p", F.explode("places")).select("id", "family", "p.lo", "p.hi", "p.side", "shingles")

    def tile(t: pa.Table) -> pa.Table:
        ids, side = t.column("id").to_numpy(), t.column("side").to_numpy()
        values = t.column("shingles").combine_chunks()
        flat, at = values.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(values.value_lengths().to_numpy(zero_copy_only=False))])
        order = np.argsort(ids, kind="stable")
        sets = {}  # a row that repeats is left out; texts of one doc_id are members of their own
        order = np.array([i for i in order if sets.setdefault((ids[i], flat[at[i] : at[i + 1]].tobytes()), i) == i], np.int64)
        one, two = order[side[order] == 0], order[side[order] == 1]
        if not len(one) or not len(two):
            one, two = order, None
        pick = lambda k: [flat[at[i] : at[i + 1]] for i in k]
        names = ids[one] if two is None else np.concatenate([ids[one], ids[two]])
        links = confirm(pick(one), None if two is None else pick(two), level)
        return pa.table({"a": pa.array([int(names[a]) for a, _ in links], pa.int64()), "b": pa.array([int(names[b]) for _, b in links], pa.int64())})

    return tiles.groupBy("family", "lo", "hi").applyInArrow(tile, "a long, b long")


def confirmed(docs: DataFrame, family: DataFrame, words: int, level: int, block: int = BLOCK) -> DataFrame:
    """(a, b): spanning links of each family, confirmed on full sets: a star of blocks, then what it leaves open."""
    sizes = family.groupBy("family").agg(F.count("*").alias("members"))
    dealt = family.join(sizes, "family").where("members > 1").withColumn("blocks", F.ceil(F.col("members") / block).cast("int"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    first = (F.col("block") == 0) & (F.col("blocks") > 1)
    of = F.when(first, F.sequence(F.lit(1), F.col("blocks") - 1)).otherwise(F.array("block"))
    place = lambda lo, hi, side: F.struct(lo.alias("lo"), hi.alias("hi"), side.alias("side"))
    star = dealt.select("id", "family", "blocks", F.transform(of, lambda o: place(o, o, F.lit(0))).alias("places"))
    made = Stash(member_sets(docs, star, words), "sets").df  # read by both rounds
    links = Stash(compared(made, level), "starred").df

    # what the star has joined, in families of several blocks
    joined = components(links)
    large = dealt.where("blocks > 1").select("id", "family", "members").join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
    counts = large.groupBy("family", "component").agg(F.count("*").alias("n"))
    most = counts.groupBy("family").agg(F.max(F.struct("n", "component")).alias("most"))
    open_ = large.join(most, "family").where("members > most.n").withColumn("inner", F.col("component") == F.col("most.component"))
    open_ = Stash(open_.select("id", "family", "inner", F.col("most.n").alias("n"), (F.col("members") - F.col("most.n")).alias("outside")), "open").df
    if open_.isEmpty():
        return links
    out, in_ = (F.ceil(F.col(k) / block).cast("int") for k in ("outside", "n"))
    nth = lambda k: F.pmod(F.xxhash64("id"), k).cast("int")
    at = open_.select("id", "family", F.when(F.col("inner"), out + nth(in_)).otherwise(nth(out)).alias("at"), F.sequence(F.lit(0), F.when(F.col("inner"), out - 1).otherwise(out + in_ - 1)).alias("others"))
    pairs = at.select("id", "family", F.transform("others", lambda o: place(F.least("at", o), F.greatest("at", o), (F.col("at") > o).cast("int"))).alias("places"))
    return links.union(compared(made.where("blocks > 1").select("id", "shingles").join(pairs, "id"), level))


def near_duplicates(docs: DataFrame, words: int = WORDS, level: int = LEVEL) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    rows = Stash(digests(docs, words), "digests").df
    some = rows.where("n > 0 and doc_id is not null")
    key = ["n", "d1", "d2"]
    classes = Stash(some.groupBy(*key).agg(F.min("doc_id").alias("rep")), "classes").df
    reps = some.join(classes, [*(some[k] == classes[k] for k in key), F.col("doc_id") == F.col("rep")], "left_semi").select(F.col("doc_id").alias("rep"), "keys").distinct()
    family = Stash(families(reps), "families").df
    links = confirmed(docs, family, words, level)
    # a doc_id with several sets is one document: it links their classes
    ends = some.groupBy("doc_id").agg(F.min(F.struct(*key)).alias("x"), F.max(F.struct(*key)).alias("y")).where("x <> y").select("doc_id")
    several = some.join(ends, "doc_id", "left_semi").select("doc_id", *key).distinct().join(classes, key).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links = Stash(links.union(several), "confirmed").df
    joined = components(links)
    whole = classes.join(joined, F.col("rep") == F.col("id"), "left").select("n", "d1", "d2", F.coalesce("component", "rep").alias("component_id"))
    member = rows.select("doc_id", "n", "d1", "d2")
    linked = member.where("n > 0 and doc_id is not null").join(whole, ["n", "d1", "d2"]).select("doc_id", "n", "component_id")
    alone = member.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return linked.union(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT w.doc_id, count(s.s) AS n FROM words w LEFT JOIN shingles s USING (doc_id) GROUP BY 1
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sizes UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), least AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1
)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sizes JOIN least USING (doc_id)
"""
