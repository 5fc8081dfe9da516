"""Sinks, caches, trial stores and guards: what is written, read back and checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattiq.operators import folders


def write_csv(df: DataFrame, path: str) -> None:
    """A result table as CSV with a header; one file to a partition."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str, date_format: str = "yyyy-MM-dd") -> DataFrame:
    """Typed scan; dates and numbers that don't parse become NULL."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("dateFormat", date_format).csv(path)


def write_ids(df: DataFrame, column: str, path: str) -> None:
    """The distinct values of a column as text, a line each."""
    df.select(F.col(column).cast("string").alias("value")).where("value IS NOT NULL").distinct().write.mode("overwrite").text(path)


def variant(folder: str, name: str, flag: bool, yes: str = "mean", no: str = "median") -> str:
    """The file that a flag chooses."""
    return f"{folder}/{name}_{yes if flag else no}"


def write_windows(df: DataFrame, path: str) -> None:
    """Adds parts to the window cache, laid out by mode and lookback; a part that is there is replaced, others stay."""
    df.write.partitionBy("mode", "lookback").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def cached_parts(spark: SparkSession, path: str) -> set[tuple[str, int]]:
    """The parts (mode, lookback) that the cache holds, from its folders; a part that was not finished has no such folder."""
    if not folders.exists(spark, path):
        return set()
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/mode=*/lookback=*"))
    names = [str(f.getPath()).split("/")[-2:] for f in found]
    return {(a.partition("=")[2], int(b.partition("=")[2])) for a, b in names}


def load_windows(spark: SparkSession, path: str, mode: str, lookback: int) -> DataFrame | None:
    """One part of the window cache, or None where it has not been written."""
    if (mode, lookback) not in cached_parts(spark, path):
        return None
    return spark.read.option("basePath", path).parquet(f"{path}/mode={mode}/lookback={lookback}")


def non_empty(df: DataFrame, what: str) -> DataFrame:
    """``df``; an action that raises ValueError if it has no rows."""
    if not df.take(1):
        raise ValueError(f"no rows left: {what}")
    return df


def complete(df: DataFrame, what: str, *columns: str) -> DataFrame:
    """``df``; an action that raises ValueError if a value of ``columns`` is missing or NaN."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.col(c).isNull() | F.isnan(c)
    if df.where(bad).take(1):
        raise ValueError(f"missing values left: {what}")
    return df


# ------------------------------------------------------------ trials


def append_trials(df: DataFrame, path: str, batch: str | None = None) -> None:
    """Adds trials to the store: an append-only table, which also is the log of the search. With the name of a batch a
    repeated write replaces the first one, so that a search that was killed while writing leaves nothing twice."""
    if batch is None:
        df.write.mode("append").parquet(path)
    else:
        df.withColumn("batch", F.lit(batch)).write.partitionBy("batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def open_trials(space: DataFrame, done: DataFrame) -> DataFrame:
    """The trials of a space that a store doesn't hold yet: what a resumed search has to run."""
    return space.join(done.select("trial").distinct(), "trial", "left_anti")


def archive_trials(spark: SparkSession, path: str, stamp: str) -> str | None:
    """Moves a store out of the way of a new search; its new path, or None if there is none."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p(path)):
        return None
    fs.rename(p(path), p(f"{path}-{stamp}"))
    return f"{path}-{stamp}"


def pruned(scores: Column, least: int = 2, floor: float = -0.1) -> Column:
    """Whether a trial is cut off: fewer than ``least`` valid fold scores, or their median below ``floor``."""
    valid = F.array_sort(F.filter(scores, lambda x: x.isNotNull() & ~F.isnan(x)))
    n = F.size(valid)
    middle = (F.get(valid, F.floor((n - 1) / 2).cast("int")) + F.get(valid, F.floor(n / 2).cast("int"))) / 2
    return F.when(n < least, True).otherwise(middle < floor)


def top_trials(trials: DataFrame, by: list[str], k: int, ascending: bool = False) -> DataFrame:
    """The k best trials of each group with their ``place``, the first of equal ones; trials without a score don't count;
    ValueError if a group has fewer."""
    trials = trials.where(F.col("score").isNotNull())
    few = trials.groupBy(*by).count().where(F.col("count") < k)
    if few.take(1):
        raise ValueError(f"fewer than {k} trials in a group")
    score = F.asc_nulls_last("score") if ascending else F.desc_nulls_last("score")
    return trials.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(score, "trial"))).where(F.col("place") <= k)
