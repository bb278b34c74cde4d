"""Line dedup with two Bloom filters: only lines that both filters suspect of repeating are shuffled and confirmed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnflow.llm.bloom import MAX_BITS, among, bits_for, build, hits_of, positions_of, seen_ids
from tarnflow.llm.common import WHITE, Stage, blank_to_empty, join_hot, short_batches, slices, table

MIN_CHARS, MIN_DOCS = 20, 3
#: So many confirmed lines at most are broadcast (24 bytes each); more are joined by shuffle.
BROADCAST_KEYS = 500_000
#: Line hashes a task holds before it hands their filter positions on.
FLUSH = 1 << 20
STRIP = WHITE.encode()


def line_keys(text: bytes, min_chars: int) -> list[bytes | None]:
    """A key for every line; None where it is too short to count."""
    out: list[bytes | None] = []
    for line in text.split(b"\n"):
        key = line.strip(STRIP).lower()
        long = len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars)
        out.append(key if long else None)
    return out


def _seen(bits: int, min_chars: int):
    def run(batches):
        hashes: list[int] = []
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                hashes.extend(map(xxhash.xxh64_intdigest, {k for k in line_keys(text, min_chars) if k is not None}))
                if len(hashes) >= FLUSH:
                    yield positions_of(np.array(hashes, dtype=np.uint64), bits)
                    hashes = []
        if hashes:
            yield positions_of(np.array(hashes, dtype=np.uint64), bits)

    return run


def digests(keys: list[bytes]) -> np.ndarray:
    """Two 64-bit numbers a key."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), dtype=">u8").astype(np.uint64).reshape(-1, 2)


def _suspects(filter_, bits: int, min_chars: int, id_name: str):
    """A row for every suspected line of a document."""

    def run(batches):
        hits = hits_of(filter_, bits)
        for batch in slices(batches):
            keys = [list({k for k in line_keys(t, min_chars) if k is not None}) for t in batch.column("_text").to_pylist()]
            flat = [k for ks in keys for k in ks]
            bad = hits(np.fromiter(map(xxhash.xxh64_intdigest, flat), dtype=np.uint64, count=len(flat)))
            owner = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys])[bad])
            told = [xxhash.xxh3_128_digest(k) for k, b in zip(flat, bad) if b]
            yield pa.RecordBatch.from_arrays([batch.column(id_name).take(owner), batch.column("_uid").take(owner), pa.array(told, pa.binary())], [id_name, "_uid", "key"])

    return run


def _written(batch: pa.RecordBatch, min_chars: int, gone) -> pa.RecordBatch:
    """The lines that stay; ``gone`` tells for a document's number and its keys which are dropped."""
    texts = batch.column("_text").to_pylist()
    kept, lines, lost = [], [], []
    for i, text in enumerate(texts):
        all_lines = text.split(b"\n")
        drop = gone[i]
        if drop:
            stay = [x for x, k in zip(all_lines, line_keys(text, min_chars)) if k not in drop]
            kept.append(b"\n".join(stay))
            lost.append(len(all_lines) - len(stay))
        else:
            kept.append(text)
            lost.append(0)
        lines.append(len(all_lines))
    return pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_rest"), pa.array(kept, pa.binary()), pa.array(lines, pa.int64()), pa.array(lost, pa.int64())], ["_id", "_rest", "_kept", "n_lines", "n_dropped"])


def _cut_by_keeper(found, min_chars: int):
    """Lines that are among the broadcast ones go, but for those of their keeper."""

    def run(batches):
        high, low, keeper = found.value  # sorted by the first
        for batch in slices(batches):
            ids = batch.column("_id").to_pylist()
            keys = [[k for k in line_keys(t, min_chars) if k is not None] for t in batch.column("_text").to_pylist()]
            flat = [k for ks in keys for k in ks]
            gone: list[set[bytes]] = [set() for _ in ids]
            if flat and len(high):
                d = digests(flat)
                at = np.searchsorted(high, d[:, 0])
                owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
                # Confirmed lines with the same first number stand side by side.
                for i in np.flatnonzero(high[np.minimum(at, len(high) - 1)] == d[:, 0]):
                    j = int(at[i])
                    while j < len(high) and high[j] == d[i, 0]:
                        if low[j] == d[i, 1] and ids[owner[i]] != keeper[j]:
                            gone[owner[i]].add(flat[i])
                        j += 1
            yield _written(batch, min_chars, gone)

    return run


def _cut_by_list(min_chars: int):
    """Lines that are on the document's list go."""

    def run(batches):
        for batch in slices(batches):
            gone = []
            for text, drop in zip(batch.column("_text").to_pylist(), batch.column("_drop").to_pylist()):
                listed = set(drop or ())
                gone.append({k for k in line_keys(text, min_chars) if k is not None and xxhash.xxh3_128_digest(k) in listed} if listed else listed)
            yield _written(batch, min_chars, gone)

    return run


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, max_bits: int = MAX_BITS, carry: tuple[str, ...] = (), broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """One row per input row: ``doc_id, kept_text, n_lines, n_dropped`` and the columns in ``carry``.

    A line's key is the line stripped of white space with A-Z lower-cased.  Keys of ``min_chars`` code points found in ``min_docs`` documents lose
    all their lines but those of the largest id holding them.

    Tasks hand on filter positions of their distinct line hashes (8 bytes a line); the filters of what is seen once and twice are merged slice by
    slice, and the second, of a size bounded by ``max_bits``, is broadcast.  Only lines it suspects are shuffled, as 128-bit digests, and counted
    exactly, pre-aggregated.  If at most ``broadcast_keys`` digests are confirmed they go to all tasks with the id that keeps them (integer ids
    only), and no text is shuffled.  Beyond that the suspected lines are joined with them, hot ones split, and only texts that a filter of the documents
    that lose lines lets through are joined with their lists.

    Null and empty texts are one empty line.  Rows that share an id are one document to be counted and keep alike.  Rows with a null id don't
    count and keep no line that is dropped elsewhere.  An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    text = blank_to_empty(F.col(text_col))
    src = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(id_col), text).alias("_uid"), F.struct(F.lit(0).alias("_"), *(F.col(c) for c in carry)).alias("_rest"), text.cast("binary").alias("_text"))
    n_lines = docs.agg(F.sum(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)).first()[0] or 1
    bits = bits_for(int(n_lines), max_bits)
    twice = build(src.select("_text").mapInArrow(_seen(bits, min_chars), "slice int, seen binary"), bits, True)

    id_field = T.StructField("_id", src.schema["_id"].dataType)
    uid, key = T.StructField("_uid", T.LongType()), T.StructField("key", T.BinaryType())
    suspects = Stage(src.mapInArrow(_suspects(twice, bits, min_chars, "_id"), T.StructType([id_field, uid, key])), "lines-suspected")
    # Distinct documents first, each a row a task at most, so a line that a third of all hold is counted by many tasks.
    held = suspects.df.select("key", "_id").distinct().groupBy("key").agg(F.count("_id").alias("n"), F.max("_id").alias("keeper"))
    heavy = Stage(held.where(F.col("n") >= min_docs), "lines-confirmed")
    out_schema = T.StructType([id_field, src.schema["_rest"], T.StructField("_kept", T.BinaryType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    whole = isinstance(id_field.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    if whole and heavy.df.count() <= broadcast_keys:
        rows = heavy.df.select("key", F.col("keeper").cast("long")).collect()  # broadcast_keys at most
        d = np.frombuffer(b"".join(bytes(r["key"]) for r in rows), dtype=">u8").astype(np.uint64).reshape(-1, 2)
        order = np.argsort(d[:, 0], kind="stable")
        found = spark.sparkContext.broadcast((d[order, 0], d[order, 1], np.array([r["keeper"] for r in rows], dtype=np.int64)[order]))
        out = src.select("_id", "_rest", "_text").mapInArrow(_cut_by_keeper(found, min_chars), out_schema)
    else:
        lost = join_hot(suspects.df, heavy.df, "key", "_uid").where(~F.col("_id").eqNullSafe(F.col("keeper")))
        drops = Stage(lost.groupBy(F.col("_id").alias("d_id"), F.col("_uid").alias("d_uid")).agg(F.collect_set("key").alias("_drop")), "lines-dropped").df  # no longer than the document
        few = bits_for(max(1, drops.count()), max_bits)
        losers = build(drops.select("d_uid").mapInArrow(seen_ids(few), "slice int, seen binary"), few, False)
        clean = src.mapInArrow(among(losers, few, False, "_uid"), src.schema).withColumn("_drop", F.lit(None).cast("array<binary>"))
        dirty = src.mapInArrow(among(losers, few, True, "_uid"), src.schema)
        dirty = dirty.join(drops, F.col("_id").eqNullSafe(F.col("d_id")) & (F.col("_uid") == F.col("d_uid")), "left").drop("d_id", "d_uid")
        out = clean.unionByName(dirty).mapInArrow(_cut_by_list(min_chars), out_schema)
    return out.select(F.col("_id").alias("doc_id"), F.col("_kept").cast("string").alias("kept_text"), "n_lines", "n_dropped", *(F.col(f"_rest.{c}").alias(c) for c in carry))


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    short_batches(spark)
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (SELECT doc_id, i, line, translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), E'\n')) AS line, generate_subscripts(string_split(coalesce(text, ''), E'\n'), 1) AS i FROM documents)),
h AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT doc_id, i, line, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM l LEFT JOIN h USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, E'\n' ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
"""
