"""Comparison of rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: vertices in both, in one only, largest and mean absolute difference."""
    both = a.select("vertex", F.col("rank").alias("x")).join(b.select("vertex", F.col("rank").alias("y")), "vertex", "full_outer")
    gap = F.abs(F.col("x") - F.col("y"))
    return both.agg(F.count_if(gap.isNotNull()).alias("both"), F.count_if(gap.isNull()).alias("one_only"), F.max(gap).alias("max_abs_diff"), F.avg(gap).alias("mean_abs_diff"))


def mismatches(a: DataFrame, b: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    both = a.select("vertex", F.col("rank").alias("x")).join(b.select("vertex", F.col("rank").alias("y")), "vertex", "full_outer")
    return both.where(~F.coalesce(F.abs(F.col("x") - F.col("y")) <= tolerance, F.lit(False)))


def top_k(ranks: DataFrame, k: int = 100) -> DataFrame:
    """The k highest ranks, equal ones by vertex."""
    return ranks.orderBy(F.desc("rank"), "vertex").limit(k)


def top_k_overlap(a: DataFrame, b: DataFrame, k: int = 100) -> DataFrame:
    return top_k(a, k).select("vertex").join(top_k(b, k).select("vertex"), "vertex").agg(F.count("*").alias("overlap"))


def average_places(ranks: DataFrame, digits: int | None = None) -> DataFrame:
    """Place of each vertex by descending rank, ties sharing the mean place.

    Places come from counts per distinct rank; ranks are range-partitioned into buckets whose counts are summed up first, so no
    task sees all distinct ranks.
    """
    value = F.round("rank", digits) if digits is not None else F.col("rank")
    counts = ranks.select("vertex", value.alias("r"))
    tied = counts.groupBy("r").agg(F.count("*").alias("m"))
    tied = tied.withColumn("bucket", F.floor(-F.log2(F.greatest("r", F.lit(1e-300))) * 64).cast("long"))
    totals = tied.groupBy("bucket").agg(F.sum("m").alias("t"))
    before = totals.select("bucket", F.coalesce(F.sum("t").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inner = F.coalesce(F.sum("m").over(Window.partitionBy("bucket").orderBy(F.desc("r")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = tied.withColumn("inner", inner).join(before, "bucket").select("r", (F.col("base") + F.col("inner") + (F.col("m") + 1) / 2.0).alias("place"))
    return counts.join(placed, "r").select("vertex", "place")


def spearman(a: DataFrame, b: DataFrame, digits: int | None = None) -> DataFrame:
    x = average_places(a, digits).withColumnRenamed("place", "x")
    return x.join(average_places(b, digits).withColumnRenamed("place", "y"), "vertex").agg(F.corr("x", "y").alias("spearman"))
