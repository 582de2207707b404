"""Table scans and the panels derived from them."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foretally.operators.blocks import number_rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hour(name: str) -> Column:
    return F.date_trunc("hour", name)


def panel_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series per event type: few long series."""
    rows = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("series_id"), "ts", "event_id", F.col("value").alias("x"))
    keys = ["series_id"]
    return number_rows(rows, keys, ["ts", "event_id"], stretch=hour("ts")).select("series_id", "block", "t", "x")


def panel_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series per user: many short series."""
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("series_id"), "ts", "event_id", F.col("value").alias("x"))
    keys = ["series_id"]
    return number_rows(rows, keys, ["ts", "event_id"], stretch=hour("ts")).select("series_id", "block", "t", "x")


def panel_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replicates: one series per (event type, weekday); the weekday is the seed."""
    rows = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("series_id"), (F.dayofweek("ts") - 1).cast("long").alias("seed"),
        "ts", "event_id", F.col("value").alias("x"))
    keys = ["series_id", "seed"]
    return number_rows(rows, keys, ["ts", "event_id"], stretch=hour("ts")).select(*keys, "block", "t", "x")


def panel_by_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items in shipping order per supplier: the volume panel."""
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("series_id"), *order,
        (F.col("l_extendedprice") / 100000).alias("x"))
    keys = ["series_id"]
    return number_rows(rows, keys, order, stretch=F.col("l_shipdate")).select("series_id", "block", "t", "x")


def panel_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order value per day and priority: a smooth panel with one row per day."""
    days = (table(spark, sf_dir, "orders")
            .groupBy(F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").alias("day"))
            .agg((F.round(F.sum("o_totalprice"), 2) / 1000).alias("x")))
    keys = ["series_id"]
    return number_rows(days, keys, ["day"], stretch=F.date_trunc("month", "day")).select("series_id", "block", "t", "x")
