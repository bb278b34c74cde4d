"""A training corpus from raw documents: quality, line dedup, near-dedup, source mix, packed sequences.

STAGES lists the steps; each takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs.
All steps but the last return the columns of documents.  Rows are judged and dropped as rows: null or repeated ids take no others with them.
Null texts are empty ones; an empty table goes through to no rows; columns that documents have besides are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnflow.llm.bloom import MAX_BITS, among, bits_for, build, seen_ids
from tarnflow.llm.common import Stage, ready, table
from tarnflow.llm.line_dedup import line_dedup
from tarnflow.llm.mix import mixed_documents
from tarnflow.llm.ngram_join import shingle_components
from tarnflow.llm.pack import pack
from tarnflow.llm.quality import score_quality


#: So many dropped rows at most are broadcast (8 bytes each); beyond, a filter of them comes before the join.
BROADCAST_ROWS = 1_000_000


def _with_row(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with a column that tells rows apart: the id if it does, else a number written once."""
    if isinstance(docs.schema["doc_id"].dataType, (T.IntegerType, T.LongType)):
        repeated = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").limit(1).count()
        if not repeated:
            return docs, "doc_id"
    name = "_row"
    while name in docs.columns:
        name += "_"
    return Stage(docs.withColumn(name, F.monotonically_increasing_id()), "numbered").df, name


def _without(docs: DataFrame, gone: DataFrame, row: str) -> DataFrame:
    """The documents whose ``row`` isn't in ``gone``, a column of that name."""
    n = gone.count()
    if n <= BROADCAST_ROWS:
        return docs.join(F.broadcast(gone), row, "left_anti").select(docs.columns)
    # Only rows that a filter of the dropped ones lets through are shuffled.
    bits = bits_for(n, MAX_BITS)
    hashed = docs.withColumn("_uid", F.xxhash64(row))
    seen = build(gone.select(F.xxhash64(row).alias("_uid")).mapInArrow(seen_ids(bits), "slice int, seen binary"), bits, False)
    clear = hashed.mapInArrow(among(seen, bits, False, "_uid"), hashed.schema)
    maybe = hashed.mapInArrow(among(seen, bits, True, "_uid"), hashed.schema)
    return clear.unionByName(maybe.join(gone, row, "left_anti").select(hashed.columns)).select(docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    ready(spark)
    # Names that the scores don't clash with.
    own = [f"_{i}" if c != "text" else "text" for i, c in enumerate(docs.columns)]
    scored = score_quality(docs.select("doc_id", *(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, own))), table(spark, sf_dir, "labels"), carry=tuple(own))
    return scored.where("predicted = 1").select(*(F.col(n).alias(c) for c, n in zip(docs.columns, own)))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that at least three documents hold stay in one of them; a document that loses all its lines stays, empty."""
    ready(spark)
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    out = line_dedup(docs, carry=rest).withColumnRenamed("kept_text", "text")
    if "n_chars" in rest:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked by shingles the one with the smallest id stays; where ids don't tell rows apart, one of them."""
    ready(spark)
    rows, row = _with_row(docs)
    found = shingle_components(rows, id_col=row)
    gone = Stage(found.where("doc_id <> component_id").select(F.col("doc_id").alias(row)), "near-copies").df
    return _without(rows, gone, row).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document taken more than once is there as often."""
    return mixed_documents(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    ready(spark)
    return pack(docs)


STAGES = [("quality", quality), ("line dedup", lines), ("near copies", near_copies), ("mix", mix), ("packing", sequences)]

#: Scores and tokens are beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        written = Stage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            before.drop()  # all that reads it has been written
        docs, before = written.df, written
    return docs
