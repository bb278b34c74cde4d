"""Ranks as text."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnflow.functions.numbers import format_rank, rank_text
from tarnflow.schemas import RANKS, GraphError

HEADER = "vertex,rank"


def csv_lines(ranks: DataFrame) -> DataFrame:
    """``vertex, line``."""
    return ranks.select("vertex", F.concat(F.col("vertex").cast("string"), F.lit(","), rank_text(F.col("rank"))).alias("line"))


def write_csv(ranks: DataFrame, path: str) -> None:
    """One file with a header, ascending vertices.  Sorted partitions stream through the driver one at a time; for large results use write_csv_parts."""
    with open(path, "w", encoding="utf-8", newline="\n") as f:
        f.write(HEADER + "\n")
        for row in ranks.orderBy("vertex").toLocalIterator(prefetchPartitions=True):
            f.write(f"{row['vertex']},{format_rank(row['rank'])}\n")


def write_csv_parts(ranks: DataFrame, path: str) -> None:
    """A folder of range-ordered files, each with a header."""
    ranks.orderBy("vertex").select("vertex", rank_text(F.col("rank")).alias("rank")).write.mode("overwrite").option("header", True).csv(path)


def _runs(batches):
    """First and last vertex of each run of a file's lines, and whether they ascend in it."""
    for batch in batches:
        files, ids = batch.column("file").to_pylist(), batch.column("vertex").to_pylist()
        out, at = [], 0
        while at < len(ids):
            end = at + 1
            while end < len(ids) and files[end] == files[at]:
                end += 1
            run = ids[at:end]
            out.append((files[at], run[0], run[-1], all(a < b for a, b in zip(run, run[1:]))))
            at = end
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.int32()), pa.array([r[3] for r in out], pa.bool_())], ["file", "first", "last", "up"])


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Ranks from text, ids checked to ascend within each file: within its runs, and no two runs of it overlap."""
    out = spark.read.schema(RANKS).option("header", True).option("enforceSchema", False).csv(path)
    if out.where("vertex IS NULL OR rank IS NULL").limit(1).count():
        raise GraphError(f"{path} holds lines that are no ranks")
    runs = out.select("vertex", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")).select("file", "vertex").mapInArrow(_runs, "file string, first int, last int, up boolean")
    told = runs.withColumn("before", F.max("last").over(Window.partitionBy("file").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)))
    if told.where("NOT up OR before >= first").limit(1).count():
        raise GraphError(f"{path}: vertices don't ascend")
    return out


def rank_sum_is_one(ranks: DataFrame, tolerance: float = 1e-9) -> bool:
    return abs((ranks.agg(F.sum("rank")).first()[0] or 0.0) - 1.0) <= tolerance
