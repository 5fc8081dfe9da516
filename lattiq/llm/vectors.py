"""Embedding near-duplicates by int8 tile products with error bounds.

Vectors that are equal form a class with a weight. Within a label (and length) classes are dealt to
blocks of about TILE, and every pair of blocks is one task: vectors are quantised to int8, one matrix
product gives all approximate cosines of the tile, and with the exact norm of each vector's
quantisation error a bound on the true cosine. Only pairs whose bound reaches the threshold are
computed again in double precision. A task returns a row per class: its number of links in the tile
and one edge of a spanning forest, never the links themselves.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and rows
with null label or null vec_id, link with nothing and are kept (a null vec_id has a null component);
vectors of different lengths link with nothing; vectors are scaled by their largest component first, so
that no finite one over- or underflows; rows that repeat a vec_id are one vector if they are equal, else
all of them share its links; equal vectors link with each other; an empty table gives an empty result;
further columns are ignored.

Every pair of blocks of a label is compared, so the work, and the rows sent, grow with the square of the
largest label's classes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.llm.common import Stash, table
from lattiq.llm.graph import components, smallest_reachable

LEVEL, TILE = 0.93, 1536
_SLACK = 1e-9  # rounding of the bound itself


def quantise(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, and the norms of what the codes leave out, of unit vectors."""
    scale = np.abs(u).max(1) / 127
    q = np.rint(u / scale[:, None]).astype(np.int8)
    return q, scale, np.linalg.norm(u - q * scale[:, None], axis=1)


def linked(x: np.ndarray, y: np.ndarray | None, level: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Positions (i, j) with cosine >= level among x (i < j), or between x and y; and how many pairs
    were computed in full."""
    x = x / np.abs(x).max(1, keepdims=True)
    z = x if y is None else y / np.abs(y).max(1, keepdims=True)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    (a, s, e), (b, t, f) = quantise(unit(x)), quantise(unit(z))
    kind = np.float32 if x.shape[1] * 127 * 127 < 1 << 24 else np.float64  # products of codes stay exact
    upper = (a.astype(kind) @ b.astype(kind).T).astype(np.float64)
    upper *= s[:, None] * t[None, :]
    na, nb = np.linalg.norm(a * s[:, None], axis=1), np.linalg.norm(b * t[:, None], axis=1)
    upper += e[:, None] * (nb + f)[None, :] + na[:, None] * f[None, :] + _SLACK
    near = upper >= level
    if y is None:
        near = np.triu(near, 1)
    i, j = np.nonzero(near)
    keep = []
    for k in range(0, len(i), 1 << 16):
        p, q = x[i[k : k + (1 << 16)]], z[j[k : k + (1 << 16)]]
        dot = np.einsum("ij,ij->i", p, q)
        keep.append(dot / np.sqrt(np.einsum("ij,ij->i", p, p) * np.einsum("ij,ij->i", q, q)) >= level)
    ok = np.concatenate(keep) if keep else np.zeros(0, bool)
    return i[ok], j[ok], len(i)


def near_vectors(vectors: DataFrame, level: float = LEVEL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    x = F.col("x")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    good = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite, F.lit(False))
    key = ["label", "k1", "k2"]
    rows = rows.select("vec_id", "label", "x", F.xxhash64("x").alias("k1"), F.xxhash64("x", F.lit(1)).alias("k2"), good.alias("good"))
    classes = rows.where("good").groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("w"), F.first("x").alias("x"))
    classes = Stash(classes.withColumn("dims", F.size("x")), "vectors").df
    blocks = classes.groupBy("label", "dims").agg(F.ceil(F.count("*") / TILE).cast("int").alias("blocks"))
    dealt = classes.join(blocks, ["label", "dims"]).withColumn("block", F.pmod(F.xxhash64("rep", F.lit(9)), F.col("blocks")).cast("int"))
    tiles = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "label", "dims", F.least("block", "o").alias("lo"), F.greatest("block", "o").alias("hi"), "block", "rep", "w", "x"
    )

    def tile(t: pa.Table) -> pa.Table:
        rep, w, block, hi, lo = (t.column(c).to_numpy() for c in ("rep", "w", "block", "hi", "lo"))
        v = t.column("x").combine_chunks().flatten().to_numpy().reshape(len(rep), -1)
        order = np.argsort(rep, kind="stable")
        one, two = order[block[order] == lo[0]], order[block[order] != lo[0]]
        links, nodes = np.zeros(len(rep), np.int64), np.concatenate([one, two])
        root = nodes
        if hi[0] == lo[0] or len(two):
            i, j, _ = linked(v[one], None if hi[0] == lo[0] else v[two], level)
            j = j if hi[0] == lo[0] else j + len(one)
            counts = np.bincount(i, w[nodes[j]], len(nodes)) + np.bincount(j, w[nodes[i]], len(nodes))
            links[nodes] = counts.astype(np.int64)
            root = nodes[smallest_reachable(len(nodes), i, j)]
        some = links[nodes] > 0
        return pa.table({"rep": rep[nodes][some], "root": rep[root][some], "n": links[nodes][some]})

    found = Stash(tiles.groupBy("label", "dims", "lo", "hi").applyInArrow(tile, "rep long, root long, n long"), "tiles").df
    joined = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    result = classes.select(*key, "rep", "w").join(counts, "rep", "left").join(joined, F.col("rep") == F.col("id"), "left")
    result = result.select(*key, (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked_rows = rows.where("good").select("vec_id", *key).join(result, key).select("vec_id", "n_links", "component_id")
    alone = rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked_rows.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP9_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.x, b.x) >= 0.93
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), least AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY 1
), counts AS (
  SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1
)
SELECT v.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN least USING (vec_id) LEFT JOIN counts USING (vec_id)
"""
