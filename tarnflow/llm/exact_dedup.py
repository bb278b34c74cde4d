"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.llm.common import Stage, blank_to_empty, join_hot, table, without_white

#: Code points of the normalised text that the second level hashes.
PREFIX_CHARS = 64
#: So many keys at most are broadcast (100 bytes each, at most).
BROADCAST_KEYS = 100_000


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after deleting all white space.  Level one counts normalised lengths, level two
    prefix hashes among lengths that repeat, level three full hashes among prefixes that repeat; rows that a level finds alone are
    done.  The digest is part of every row's result, so the one pass over the texts makes it with length and prefix hash, and the levels
    decide whose digests are compared at all.  Only narrow rows are ever shuffled, never a text.  Every group is pre-aggregated before its
    shuffle, and keys go back to their rows by broadcast up to ``broadcast_keys`` of them, else by joins that split hot keys.

    Of a group the row with the most code points in its original text, then the smallest id, stays.  Null text is
    empty.  Null ids are allowed: they lose every tie against other ids.  Rows that repeat an id and a text are separate
    rows of one group; they share keep_id and kept.  An empty table gives an empty result; other columns are ignored.
    """
    norm = F.col("norm")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.char_length(blank_to_empty(F.col(text_col))).alias("n_cp"), without_white(F.col(text_col)).alias("norm"))
    level = F.char_length(norm).cast("long")
    rows = Stage(texts.select("doc_id", "n_cp", level.alias("len"), F.xxhash64(level, F.substring(norm, 1, prefix_chars)).alias("prefix"), F.sha2(norm.cast("binary"), 256).alias("text_sha256")), "exact-rows").df
    lengths = Stage(rows.groupBy("len").agg(F.count("*").alias("n")).where("n > 1"), "exact-lengths").df
    same_length = join_hot(rows, lengths, "len", "doc_id", "left_semi", small=broadcast_keys)
    prefixes = Stage(same_length.groupBy("prefix").agg(F.count("*").alias("n")).where("n > 1"), "exact-prefixes").df
    same_prefix = join_hot(rows, prefixes, "prefix", "doc_id", "left_semi", small=broadcast_keys)
    best = F.min(F.struct(-F.col("n_cp"), F.col("doc_id").isNull(), F.col("doc_id")))
    groups = Stage(same_prefix.groupBy("text_sha256").agg(best.alias("best"), F.count("*").alias("n")).where("n > 1").select("text_sha256", F.col("best.doc_id").alias("k"), "n"), "exact-groups").df
    out = join_hot(rows, groups, "text_sha256", "doc_id", "left", small=broadcast_keys)
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("k"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), "text_sha256")


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents),
w AS (SELECT doc_id, h, first_value(doc_id) OVER (PARTITION BY h ORDER BY length(text) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY h) AS n FROM t)
SELECT doc_id, keep_id, n AS group_size, keep_id = doc_id AS kept, h AS text_sha256 FROM w
"""
