"""An entity's cells as one row, and sums of arrays over all entities.

The modes of features and periods are bounded, the entities are not. So a panel becomes a table with a row for each
entity, which holds the places and values of its cells; kernels make dense arrays of a batch of them; and what models
need of all entities are sums of such arrays. A task adds up its own share, sends it in blocks of BLOCK numbers, and
blocks are added up as they stream in: no task holds more than one array of the sum's size, and only
the sum itself reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers in a block of a sum; and in a dense array that a kernel makes of a batch.
BLOCK, BATCH = 8192, 1 << 17


@dataclass(frozen=True)
class Axes:
    """The bounded modes: features in order, first period, number of periods, and the places of periods with a value."""

    features: tuple
    first: int
    periods: int
    seen: tuple

    @property
    def size(self) -> int:
        return len(self.features) * self.periods

    def windows(self, lags: int, drop_last: bool = True) -> np.ndarray:
        """The places of the first inputs of the windows: ``lags`` periods, then a target for which some cell has a value."""
        last = self.periods - 1 - drop_last
        return np.array([p - lags for p in self.seen if lags <= p <= last], int)


def axes(long: DataFrame) -> Axes:
    found = long.where("value IS NOT NULL").select("feature", "period").distinct().collect()  # features x periods at most
    features, seen = sorted({r[0] for r in found}), sorted({r[1] for r in found})
    first = seen[0] if seen else 0
    return Axes(tuple(features), first, seen[-1] - first + 1 if seen else 0, tuple(p - first for p in seen))


def by_entity(long: DataFrame, a: Axes) -> DataFrame:
    """(entity, pos, value): the cells of each entity, at feature * periods + period."""
    place = (F.array_position(F.array(*map(F.lit, a.features)), F.col("feature")) - 1) * a.periods + F.col("period") - a.first
    cells = F.collect_list(F.struct(place.cast("int").alias("pos"), "value"))
    return long.where("value IS NOT NULL").groupBy("entity").agg(cells.alias("c")).select("entity", F.col("c.pos").alias("pos"), F.col("c.value").alias("value"))


def dense(batch: pa.RecordBatch, size: int):
    """Parts of a batch of ``by_entity``: (row numbers, array of rows x size), NaN where no cell is."""
    step = max(1, BATCH // max(size, 1))
    for start in range(0, len(batch), step):
        part = batch.slice(start, step)
        pos = part.column("pos")
        lengths = np.diff(np.asarray(pos.offsets))
        x = np.full((len(part), size), np.nan)
        x[np.repeat(np.arange(len(part)), lengths), np.asarray(pos.flatten())] = np.asarray(part.column("value").flatten())
        yield np.arange(start, start + len(part)), x


def summed(rows: DataFrame, add, size: int) -> np.ndarray:
    """``size`` numbers: the sum over all rows; ``add(batch, total)`` adds those of an Arrow batch to ``total``."""

    def partial(batches):
        total, any_rows = np.zeros(size), False
        for batch in batches:
            if len(batch):
                add(batch, total)
                any_rows = True
        if any_rows:
            yield from packed({k: total[k * BLOCK : (k + 1) * BLOCK] for k in range(-(-size // BLOCK))})

    def packed(blocks):
        if blocks:
            yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int32()), pa.array([b.tobytes() for b in blocks.values()], pa.binary())], names=["block", "sum"])

    def together(batches):
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, b in zip(batch.column("block").to_pylist(), batch.column("sum")):
                more = np.frombuffer(b.as_buffer(), np.float64)
                blocks[k] = blocks[k] + more if k in blocks else more.copy()
        yield from packed(blocks)

    schema = "block int, sum binary"
    shares = rows.mapInArrow(partial, schema).repartition(min(16, -(-size // BLOCK)), "block").mapInArrow(together, schema)
    out = np.zeros(size)
    for r in shares.collect():
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["sum"], np.float64)
    return out


def cell_gramian(rows: DataFrame, a: Axes) -> np.ndarray:
    """Over pairs of cells (feature, period): products summed over all entities, missing as zero."""
    n = a.size

    def add(batch, total):
        for _, x in dense(batch, n):
            x = np.nan_to_num(x, copy=False)
            total.reshape(n, n)[...] += x.T @ x

    return summed(rows, add, n * n).reshape(n, n)
