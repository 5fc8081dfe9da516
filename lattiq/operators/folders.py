"""The folder that driver and executors share, and what is written there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None


def shared(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where that is unset and the session is one process."""
    global _own
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _own is None:
        _own = "file://" + tempfile.mkdtemp(prefix="lattiq-plans-")
    return _own


def new(spark: SparkSession, tag: str) -> str:
    return f"{shared(spark)}/lattiq-plans/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` as Parquet, read again."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(df: DataFrame) -> DataFrame:
    """``df`` worked out once: in the shared folder of spark.checkpoint.dir where it is set, else in memory and on disk."""
    if df.sparkSession.sparkContext.getConf().get("spark.checkpoint.dir"):
        return df.checkpoint()
    return df.persist()


def held(df: DataFrame):
    """``df`` worked out once, and a function that frees it: as ``kept``, but its files go with that call, not with the session."""
    spark = df.sparkSession
    if not spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        df = df.persist()
        return df, df.unpersist
    path = new(spark, "held")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return written(df, path), lambda: p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
