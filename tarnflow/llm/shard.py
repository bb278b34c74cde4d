"""Sharding by Hilbert-curve order: quantise metadata, sort by curve index, cut runs.  DataFrame functions only."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.llm.common import Stage, blank_to_empty, table

#: Bits of each dimension; three dimensions give 4096 cells.
BITS = 4
DIMENSIONS = 3
#: Rows that one task ranks at most, about: cells with more are split.
RANK_ROWS = 100_000


def hilbert_index(point: tuple[int, ...], bits: int) -> int:
    """Curve index of a cell, by undoing the curve's reflections and exchanges from the highest bit down, then Gray decoding."""
    x, n = list(point), len(point)
    high = 1 << (bits - 1)
    q = high
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                swap = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= swap
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip, q = 0, high
    while q > 1:
        if x[n - 1] & q:
            flip ^= q - 1
        q >>= 1
    out = 0
    for bit in range(bits - 1, -1, -1):
        for v in x:
            out = out << 1 | (v ^ flip) >> bit & 1
    return out


def _curve(bits: int) -> Column:
    """Curve index by cell number, as one constant array of 2 ** (3 * bits) entries."""
    side = 1 << bits
    cells = (hilbert_index((a, b, c), bits) for a in range(side) for b in range(side) for c in range(side))
    return F.split(F.lit(",".join(map(str, cells))), ",").cast("array<int>")


def _number(value: Column, skip: int) -> Column:
    """The first seven bytes from ``skip`` on as a number that sorts as they do; null sorts first."""
    head = F.rpad(F.hex(F.substring(value.cast("binary"), skip + 1, 7)), 14, "0")
    return F.coalesce(F.conv(head, 16, 10).cast("long"), F.lit(-1))


def _shared_bytes(low: str | None, high: str | None) -> int:
    """How many bytes the least and the greatest value begin with alike, and so all between them."""
    a, b = (low or "").encode(), (high or "").encode()
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def _level(number: Column, edges: list, cells: int) -> Column:
    """How many of the sorted edges lie below, few levels spread over all cells: cells in the order of the values."""
    levels = sorted(set(edges))
    below = sum((F.when(number > e, 1).otherwise(0) for e in levels), F.lit(0))
    return F.floor(below * cells / (len(levels) + 1)).cast("int")


def _edges(numbers: DataFrame, column: str, cells: int) -> list:
    """The quantiles of a column that cut it into cells, by a mergeable sketch over all rows."""
    found, most = numbers.agg(F.percentile_approx(column, [i / cells for i in range(1, cells)], 10_000), F.max(column)).first()
    return [x for x in found or [] if x < most]


def hilbert_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", dims: tuple[str, ...] = ("source", "lang"), bits: int = BITS, rank_rows: int = RANK_ROWS) -> DataFrame:
    """One row per input row: ``doc_id, size, text_crc32, law, shard, slot, grown_shard, curve``.

    The dimensions are the text's size, cut at quantiles of the rows, and two metadata columns, cut at quantiles of their distinct values in
    sorted order (by the first seven bytes in which they differ).  So cells keep the order of each dimension, a shard is one run of the curve, and min/max
    statistics of its file rule it out for most sizes and values.  Law ``rows``: runs are cut at equal counts, so shards differ by one row at most.

    Equal texts stand next to each other within a cell; only the cut between two shards, which the law fixes, may part them.  The place of a row is the number of
    rows before its part plus its rank in it.  Parts are ranges of a text hash with about ``rank_rows`` rows; texts with more copies are parts of
    their own, split by a hash of the id.  So a cell or a text with a third of all rows is ranked by many tasks; the counts of parts that are summed
    up are bounded by rows / rank_rows and the cells.  Texts are never shuffled.

    Null text has size 1 (no bytes) and the checksum of the empty text; null metadata is a value of its own that sorts first; null ids sort first.
    Repeated rows get places of their own.  An empty table gives no rows; other columns are ignored.
    """
    side = 1 << bits
    text = blank_to_empty(F.col(text_col))
    size = F.octet_length(text).cast("long") + 1
    values = [F.col(d).cast("string") if d in docs.columns else F.lit(None).cast("string") for d in dims]
    narrow = docs.select(F.col(id_col).alias("doc_id"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"), *(v.alias(f"v{i}") for i, v in enumerate(values)))
    rows = Stage(narrow, "shard-narrow").df
    told = rows.agg(F.count("*").alias("n"), *(f(f"v{i}").alias(f"{f.__name__}{i}") for i in range(len(dims)) for f in (F.min, F.max))).first()
    total = told["n"]
    levels = [_level(F.col("size"), _edges(rows, "size", side), side)]
    for i in range(len(dims)):
        number = _number(F.col(f"v{i}"), _shared_bytes(told[f"min{i}"], told[f"max{i}"]))
        levels.append(_level(number, _edges(rows.select(number.alias("x")).distinct(), "x", side), side))
    cell = (levels[0] * side + levels[1]) * side + levels[2]
    split = max(1, -(-total // rank_rows))
    many = rows.groupBy("h").agg(F.count("*").alias("m")).where(F.col("m") > rank_rows).select("h").collect() if total > rank_rows else []  # total / rank_rows at most
    own = F.col("h").isin([r["h"] for r in many]) if many else F.lit(False)
    # A part: a range of the text hash in the cell, and behind it each text of many copies in it, in pieces.
    span = (F.shiftrightunsigned("h", 32) * split / float(1 << 32)).cast("int")
    keyed = rows.select("doc_id", "size", "text_crc32", "h", F.element_at(_curve(bits), cell + 1).alias("curve"), span.alias("span"), F.when(own, F.col("h")).alias("copy"), F.when(own, F.pmod(F.xxhash64("doc_id"), F.lit(split)).cast("int")).otherwise(0).alias("piece"))
    part = ["curve", "span", "copy", "piece"]
    counts = keyed.groupBy(*part).agg(F.count("*").alias("n"))
    in_cell = Window.partitionBy("curve").orderBy("span", F.col("copy").asc_nulls_first(), "piece").rowsBetween(Window.unboundedPreceding, -1)
    cells = counts.groupBy("curve").agg(F.sum("n").alias("m"))
    before = cells.select("curve", F.coalesce(F.sum("m").over(Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # one row a cell
    starts = counts.withColumn("inner", F.coalesce(F.sum("n").over(in_cell), F.lit(0))).join(before, "curve").select("curve", "span", "copy", "piece", (F.col("base") + F.col("inner")).alias("start"))
    rank = F.row_number().over(Window.partitionBy(*part).orderBy("h", "doc_id", "size")) - 1
    wide = keyed.withColumn("rank", rank)
    same = [wide[c].eqNullSafe(starts[c]) if c == "copy" else wide[c] == starts[c] for c in part]
    # AQE broadcasts the starts while they are small.
    placed = wide.join(starts, reduce(and_, same)).select("doc_id", "size", "text_crc32", wide["curve"], "rank", "start")
    placed = placed.withColumn("place", F.col("start") + F.col("rank"))
    base, rest = divmod(total, shards)
    edge, place = rest * (base + 1), F.col("place")
    shard = F.when(place < edge, F.floor(place / (base + 1))).otherwise(rest + F.floor((place - edge) / max(base, 1)))
    first = F.when(F.col("shard") < rest, F.col("shard") * (base + 1)).otherwise(edge + (F.col("shard") - rest) * base)
    out = placed.withColumn("shard", shard.cast("int")).withColumn("slot", (place - first).cast("long"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op9_hilbert_shards(spark, sf_dir: str) -> DataFrame:
    return hilbert_shards(table(spark, sf_dir, "documents"))
