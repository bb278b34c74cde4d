"""Mixing sources to target weights by capped water-filling.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.llm.common import WORD_PATTERN, Stage, blank_to_empty, table

#: Weights by the order of the sources, repeating.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
#: The rules of so many sources at most are broadcast (100 bytes each).
BROADCAST_SOURCES = 100_000


def _words(text: Column) -> Column:
    return F.regexp_count(blank_to_empty(text), F.lit(WORD_PATTERN)).cast("long")


def _order(key: Column, seed: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), key.cast("string")))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: ``doc_id, source, order, size, source_size, target, taken, whole, part``.

    Sources in code point order (null last) get ``weights`` in turn and share all words.  A source stops at
    ``max_epochs`` times its size; what it can't use goes to the others by weight until none is above.  Repeated clamping has
    one fixed point, found here in one pass: with sources in order of capacity a unit of weight, the water level is the first quotient (the
    largest that is fit) of the words and the weight left that the source at hand can hold.

    Each document is taken ``whole`` times and, in a seeded order within the source, once more until the source's words are used; of
    the document in which they run out the first ``part`` words are taken.  So a source's words are its rounded target exactly.
    The seeded order's running sum goes by 4096 buckets of the seeded hash, then within a bucket: a source with a third of all rows is
    split over its buckets.

    Null text has no words.  Sources without words have target 0.  Repeated rows are documents of their own; rows alike in id and size are
    interchangeable.  An empty table gives no rows; other columns are ignored.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), _words(F.col(text_col)).alias("size"))
    narrow = narrow.withColumn("order", _order(F.col("doc_id"), seed)).withColumn("bucket", F.substring("order", 1, 3))
    rows = Stage(narrow, "mix-narrow")
    buckets = rows.df.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    sources = buckets.groupBy("source").agg(F.sum("n").alias("source_size"))
    # One row a source from here: windows over all of them are as small as the list of sources (a million sorts in a task's memory).
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int")).cast("long")
    sized = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_epochs)
    by_room = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    all_rows, earlier = Window.partitionBy(), by_room.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(earlier), F.lit(0))
    heft = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))
    filled = sized.withColumn("level", left / heft).withColumn("room", F.col("cap") / F.col("weight"))
    water = F.max(F.when(F.col("level") <= F.col("room"), F.col("level"))).over(all_rows)
    filled = filled.withColumn("water", water).withColumn("target", F.when(F.col("room") <= F.col("water"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("water")))
    filled = filled.withColumn("use", F.floor(F.col("target") + 0.5).cast("long"))
    safe = F.greatest("source_size", F.lit(1))
    plan = filled.select("source", "source_size", "target", F.floor(F.col("use") / safe).cast("long").alias("whole"), (F.col("use") % safe).alias("rest"))
    same = lambda x, y: F.col(f"{x}.source").eqNullSafe(F.col(f"{y}.source"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = buckets.withColumn("before", before).alias("b").join(plan.alias("p"), same("b", "p")).select("b.source", "b.bucket", "before", "source_size", "target", "whole", "rest")
    inner = Window.partitionBy("source", "bucket").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.df.withColumn("inner", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    both = ranked.alias("r").join(starts.alias("s"), same("r", "s") & (F.col("r.bucket") == F.col("s.bucket")))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before") - F.col("inner")))
    return both.select("doc_id", "r.source", "order", "size", "source_size", "target", (F.col("whole") * F.col("size") + part).cast("long").alias("taken"), "whole", part.cast("long").alias("part"))


def thresholds(plan: DataFrame) -> DataFrame:
    """Per source: ``whole`` copies, and the row ``last`` of the seeded order in which its words run out, of which copies share the rest.

    ``last`` holds the order, the size, the words left and how many rows are alike there (rows that repeat an id); it is null where nothing is left.
    """
    alike = plan.groupBy("source", "order", "size").agg(F.first("whole").alias("whole"), F.sum("part").alias("left"), F.count("*").alias("rows"))
    last = F.max(F.when(F.col("left") > 0, F.struct("order", "size", "left", "rows")))
    return alike.groupBy("source").agg(F.first("whole").alias("whole"), last.alias("last"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself, in the columns of ``docs``: whole copies, and the document in which a source's words run out cut after its last word.

    Each source's place in the seeded order where its words run out goes to its rows (one row a source), which then decide for themselves: no
    text is shuffled.  Copies of a document repeat its id, as epochs do.  Rows alike in id and size at that place share the words left evenly, rounded down.
    """
    names = [c if c.isidentifier() else f"`{c}`" for c in docs.columns]
    plan = mix_sources(docs, weights, max_epochs, seed, id_col, text_col, source_col)
    rules = Stage(thresholds(plan), "mix-rules").df.withColumnRenamed("source", "_source")
    row = docs.select(F.struct(*names).alias("row"), F.col(source_col).cast("string").alias("own"), _order(F.col(id_col), seed).alias("order"), _words(F.col(text_col)).alias("size"))
    small = rules.count() <= BROADCAST_SOURCES
    ruled = row.join(F.broadcast(rules) if small else rules, F.col("own").eqNullSafe(F.col("_source")))
    here, there = F.struct("order", "size"), F.struct("last.order", "last.size")
    part = F.when(F.col("last").isNull() | (here > there), 0).when(here < there, F.col("size")).otherwise(F.least(F.col("size"), F.floor(F.col("last.left") / F.col("last.rows"))))
    ruled = ruled.withColumn("part", part)
    full = F.col("whole") + F.when((F.col("part") == F.col("size")) & ((F.col("size") > 0) | (F.col("whole") == 0)), 1).otherwise(0)
    cut = F.when((F.col("part") > 0) & (F.col("part") < F.col("size")), 1).otherwise(0)
    copies = ruled.withColumn("full", full).withColumn("copy", F.explode(F.when(full + cut > 0, F.sequence(F.lit(1), (full + cut).cast("int"))).otherwise(F.array().cast("array<int>"))))
    text = F.col(f"row.{text_col}")
    words = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")  # each with the white space before it
    text = F.when(F.col("copy") > F.col("full"), F.array_join(F.slice(words, F.lit(1), F.col("part").cast("int")), "")).otherwise(text)
    out = copies.select("row.*", text.alias("_text")).withColumn(text_col, F.col("_text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length(text_col).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op8_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).drop("source", "order")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('mix-1:' || doc_id::VARCHAR) AS o FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (SELECT *, CASE i % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS weight, 3 * source_size AS cap FROM s),
r AS (SELECT *, cap / weight AS room, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level
      FROM w WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (SELECT max(level) FROM r WHERE level <= room) AS water FROM r),
t AS (SELECT *, CASE WHEN room <= water THEN cap::DOUBLE ELSE weight * water END AS target FROM l),
u AS (SELECT *, floor(target + 0.5)::BIGINT AS use FROM t),
x AS (SELECT d.*, source_size, target, use, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY o, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source),
y AS (SELECT *, use // greatest(source_size, 1) AS whole, greatest(0, least(size, use % greatest(source_size, 1) - before)) AS part FROM x)
SELECT doc_id, size, source_size, target, (whole * size + part)::BIGINT AS taken, whole::BIGINT AS whole, part::BIGINT AS part FROM y
"""
