"""What the training-data operators share: tables, written tables, text buffers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words as the contracts define them: runs of anything but ASCII white space.
WORD_REGEX = r"[^\x20\x09-\x0D]+"

#: Bytes of text that a kernel works on at once; a longer text is worked through in parts.
PIECE = 256 << 10
_BASE = 0x9E3779B97F4A7C15

_own_root: str | None = None
_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A temporary folder serves only where the setting is unset and the session runs in one
    process (tests); on a cluster the missing setting is an error.
    """
    global _own_root
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_root is None:
        _own_root = "file://" + tempfile.mkdtemp(prefix="lattiq-")
    return _own_root


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_root(spark)}/lattiq/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    if path in _written:
        _written.remove(path)


@atexit.register
def _drop_all() -> None:
    spark = SparkSession._instantiatedSession
    if spark is None or spark.sparkContext._jsc is None:
        return
    for path in list(_written):
        try:
            drop_path(spark, path)
        except Exception:  # the JVM may have gone first; nothing is left to clean with
            return


class Stash:
    """A table written to the shared folder and read again: cuts the plan, survives lost executors."""

    def __init__(self, df: DataFrame, tag: str):
        self.spark = df.sparkSession
        self.path = new_path(self.spark, tag)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        drop_path(self.spark, self.path)


def stash(df: DataFrame, tag: str) -> DataFrame:
    return Stash(df, tag).df


def numbered(df: DataFrame, *order) -> DataFrame:
    """``df`` with ``nth``, the place of each row from 0 on in a total order.

    Rows are dealt by range and sorted in their partitions; only the partitions' counts are added up in one task.
    """
    at = Stash(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered").df
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = at.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return at.join(F.broadcast(before), part == F.col("_part")).withColumn("nth", inside + F.col("_before")).drop("_at", "_part", "_before")


def words_of(text):
    """Array of the words of a text column; null texts have none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD_REGEX), F.lit(0))


def fold(column, mod: int):
    """crc32 of the id as text, modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % mod


def raw_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow text column and the n + 1 offsets of its rows; null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), offs - offs[0]
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def pieces(offsets: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes; a longer text is a range of its own, never cut."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1)
        yield start, min(end, n)
        start = min(end, n)


def released(batches):
    """Passes batches on; when the task ends, memory that was freed goes back to the system, as workers are reused."""
    try:
        yield from batches
    finally:
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
            ctypes.CDLL("libc.so.6").malloc_trim(0)


def arrow_map(df: DataFrame, kernel, schema) -> DataFrame:
    """mapInArrow whose tasks give back their memory."""
    return df.mapInArrow(lambda batches: released(kernel(batches)), schema)


@contextlib.contextmanager
def scratch(spark: SparkSession, keep: list[str]):
    """Deletes the tables written inside, but for those that ``keep`` names at the end."""
    before = set(_written)
    try:
        yield
    finally:
        for path in [p for p in _written if p not in before and not any(k in p for k in keep)]:
            drop_path(spark, path)


def powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i < n."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply, xor-shift), applied to every element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, part: int = PIECE) -> np.ndarray:
    """A 64-bit hash of data[begin:end] of each span; spans are disjoint and ascending.

    Polynomials modulo 2 ** 64 over mixed symbols, from prefix sums of ``part`` symbols at a time, so
    that only these, not all of a long text, are held as wide numbers.
    """
    out = np.zeros(len(begin), np.uint64)
    size = min(part, len(data))
    up, down = powers(_BASE, size), powers(pow(_BASE, -1, 1 << 64), size)
    for at in range(0, len(data), part):
        stop = min(at + part, len(data))
        first, last = np.searchsorted(end, at, "right"), np.searchsorted(begin, stop, "left")
        if first >= last:
            continue
        prefix = np.zeros(stop - at + 1, np.uint64)
        np.cumsum(mix64(data[at:stop] + np.uint64(1)) * up[: stop - at], out=prefix[1:])
        b, e = np.maximum(begin[first:last], at) - at, np.minimum(end[first:last], stop) - at
        got = (prefix[e] - prefix[b]) * down[np.minimum(b, size - 1)]
        if begin[first] < at:  # goes on from the part before
            got[:1] *= np.uint64(pow(_BASE, at - int(begin[first]), 1 << 64))
        out[first:last] += got
    return mix64(out + (end - begin).astype(np.uint64))
