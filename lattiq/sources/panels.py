"""Readers, sinks and the three canonical panels, long: (entity, feature, period, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.functions.scalar import day, finite, quarter


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unpivot(wide: DataFrame, features: list[str]) -> DataFrame:
    """Wide panel (entity, period, features) as coordinates; NULL and NaN cells are absent."""
    long = wide.unpivot(["entity", "period"], features, "feature", "value")
    return long.withColumn("value", finite(F.col("value").cast("double"))).where("value IS NOT NULL").select("entity", "feature", "period", "value")


def exact(column: str):
    """The sum of amounts with two decimals, free of rounding."""
    return F.sum(F.col(column).cast("decimal(18,2)")).cast("double")


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier by quarter, wide; dense. Money and rates are added as decimals, so sums don't depend on their order."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("entity"), quarter(F.col("l_shipdate")).alias("period"), "l_quantity", "l_extendedprice", "l_discount")
    return rows.groupBy("entity", "period").agg(F.sum("l_quantity").alias("qty"), exact("l_extendedprice").alias("price"), (exact("l_discount") / F.count("l_discount")).alias("discount"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer by quarter, wide; about a third of the cells are there."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity"), quarter(F.col("o_orderdate")).alias("period"), "o_totalprice")
    return rows.groupBy("entity", "period").agg(exact("o_totalprice").alias("total"), F.count("*").alias("orders"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User by day by event type, long."""
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("entity"), F.col("event_type").alias("feature"), day(F.col("ts")).alias("period"), "value")
    return rows.groupBy("entity", "feature", "period").agg(F.sum("value").alias("value"))
