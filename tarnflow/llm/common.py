"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.materialise import Stage as Stage  # the operators take it from here
from tarnflow.session import ship_code

#: Fixed value: the white space of every contract here (space and U+0009 to U+000D).
WHITE = " \t\n\x0b\x0c\r"
#: Fixed value: a word is a run of anything else, as a Java and RE2 pattern.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


#: Rows that a Python worker handles at once, so that few texts are Python objects at a time.
SLICE = 512
#: Rows of an Arrow batch, which the JVM and the worker hold whole, both ways.
BATCH_ROWS, ARROW_ROWS = 2_048, "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Bytes of a batch on its way to Python, and rows that the Parquet reader holds decoded, where rows alone are no bound because texts are long.
BATCH_BYTES, ARROW_BYTES = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
READER_ROWS, PARQUET_ROWS = 512, "spark.sql.parquet.columnarReaderBatchSize"


def release() -> None:
    """Give memory that a Python worker freed back to the system: workers live on and serve other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batches):
    """Arrow batches in short pieces."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)
    release()


def tidy(f):
    """A function of one or two whole groups that leaves no memory behind.  Spark counts its parameters, so they are spelt out."""

    def one(group):
        try:
            return f(group)
        finally:
            release()

    def two(left, right):
        try:
            return f(left, right)
        finally:
            release()

    return one if f.__code__.co_argcount == 1 else two


def ready(spark: SparkSession) -> None:
    """Give the executors this package, and bound the texts that one Arrow batch holds on its way to and from Python."""
    ship_code(spark)
    if int(spark.conf.get(ARROW_ROWS)) > BATCH_ROWS:
        spark.conf.set(ARROW_ROWS, BATCH_ROWS)


def short_batches(spark: SparkSession) -> None:
    """Bound the texts that tasks hold at once by bytes, and what the Parquet reader decodes ahead; results don't depend on it."""
    spark.conf.set(ARROW_BYTES, BATCH_BYTES)
    if int(spark.conf.get(PARQUET_ROWS)) > READER_ROWS:
        spark.conf.set(PARQUET_ROWS, READER_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blank_to_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def without_white(text: Column) -> Column:
    """The text (null: empty) with every white space character deleted."""
    out = blank_to_empty(text)
    for c in WHITE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


#: A key is hot from this share of all rows on, if it has so many rows.
HOT_SHARE, HOT_ROWS = 0.002, 500
SALTS = 64


def join_hot(rows: DataFrame, groups: DataFrame, key: str, by: str, how: str = "inner", n: str = "n", small: int = 0) -> DataFrame:
    """``rows`` joined with their groups (one row a key, ``n`` rows in each), rows of hot keys dealt to SALTS parts by a hash of ``by``.

    At most 1 / HOT_SHARE keys are hot; their hashes are on the driver.  With at most ``small`` groups they are broadcast instead.
    """
    told = groups.agg(F.sum(n), F.count("*")).first()
    if told[1] <= small:
        return rows.join(F.broadcast(groups), key, how)
    hot = groups.where(F.col(n) >= max(HOT_ROWS, HOT_SHARE * (told[0] or 0))).select(F.xxhash64(key)).distinct().collect()
    return join_split(rows, groups, key, by, [r[0] for r in hot], how)


def join_split(rows: DataFrame, groups: DataFrame, key: str, by: str, hot: list[int], how: str) -> DataFrame:
    """The same with the hashes of the hot keys; their rows of ``groups`` are repeated for each part."""
    if not hot:
        return rows.join(groups, key, how)
    is_hot = F.xxhash64(key).isin(hot)
    parts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    salted = rows.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(by, F.lit("salt")), F.lit(SALTS)).cast("int")).otherwise(0))
    return salted.join(groups.withColumn("_salt", F.explode(parts)), [key, "_salt"], how).drop("_salt")
