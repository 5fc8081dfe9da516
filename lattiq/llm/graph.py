"""Connected components of an undirected graph, distributed, without driver-side links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattiq.llm.common import Stash


def components(edges: DataFrame, tag: str = "links") -> DataFrame:
    """(id, component) for every id in ``edges`` (a, b): component is the smallest id reachable.

    Alternates the large-star and small-star steps until the edges stand still; then every id has one
    edge, to the smallest. Each step aggregates minima, with a partial minimum in every task, writes them
    and joins them back: the two sides of that join are plain tables, so that adaptive execution can split the
    edges of a hot id. Each round is written to the shared folder, which cuts lineage.
    """
    pair = lambda a, b: edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    now = Stash(pair("a", "b").where("u <> v").distinct(), tag)
    mark = None
    while True:
        both = now.df.union(now.df.select("v", "u"))
        least = Stash(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.where("v > u").join(least.df, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        after_large = Stash(large, tag)
        least.drop()
        kept = Stash(after_large.df.groupBy("u").agg(F.min("v").alias("m")), "least")
        low = kept.df
        joined = after_large.df.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", "m")).distinct()
        after = Stash(small, tag)
        for gone in (now, after_large, kept):
            gone.drop()
        now = after
        seen = now.df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        mark = seen
    return now.df.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.df.select("v", "v").distinct())


def smallest_reachable(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest one it reaches by the links."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, low[i])
        new = new[new]
        if (new == low).all():
            return low
        low = new
