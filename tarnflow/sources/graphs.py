"""Graphs that the sample tables hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnflow.sources.edge_text import from_dataframe


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_supp(spark, sf_dir, transpose=False) -> DataFrame:
    return from_dataframe(_read(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey", transpose)


def supp_part(spark, sf_dir) -> DataFrame:
    return part_supp(spark, sf_dir, transpose=True)


def _orders(spark, sf_dir, dst) -> DataFrame:
    lines = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), dst)
    return from_dataframe(_read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(lines, "o_orderkey"), "o_custkey", dst)


def cust_supp(spark, sf_dir) -> DataFrame:
    return _orders(spark, sf_dir, "l_suppkey")


def cust_part(spark, sf_dir) -> DataFrame:
    return _orders(spark, sf_dir, "l_partkey")


def event_next(spark, sf_dir) -> DataFrame:
    """From each event's user to the next event's.  Order is found within hours, then each hour's last row takes the next hour's first:
    the only window over everything has a row an hour."""
    events = _read(spark, sf_dir, "events").select("ts", "event_id", "user_id").withColumn("hour", F.date_trunc("hour", "ts"))
    firsts = events.groupBy("hour").agg(F.min(F.struct("ts", "event_id", "user_id")).alias("head"))
    later = firsts.select("hour", F.lead("head.user_id").over(Window.orderBy("hour")).alias("later"))
    own = events.withColumn("next", F.lead("user_id").over(Window.partitionBy("hour").orderBy("ts", "event_id")))
    return from_dataframe(own.join(later, "hour").withColumn("dst", F.coalesce("next", "later")).where("dst IS NOT NULL"), "user_id", "dst")


GRAPHS = {"part_supp": part_supp, "cust_supp": cust_supp, "cust_part": cust_part, "supp_part": supp_part, "event_next": event_next}
