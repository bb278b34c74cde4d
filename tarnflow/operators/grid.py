"""Interval layout of vertices and edges, and the planner that chooses the number of intervals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnflow.schemas import BLOCK_ALIGN, BLOCK_INDEX, CHUNK_VERTICES, COLUMN_BYTES, DEGREE_BYTES, EDGE_BYTES, INDEX_BYTES, KIB, LINE_BYTES, MIB, SCORE_BYTES, TIB, GraphError


@dataclass(frozen=True)
class PartitionScheme:
    """Ids 0..max_id cut into intervals of equal length, the last shorter or empty."""

    max_id: int
    partitions: int

    @property
    def interval(self) -> int:
        return -(-(self.max_id + 1) // self.partitions)

    def base(self, i: int) -> int:
        return i * self.interval

    def length(self, i: int) -> int:
        return max(0, min(self.interval, self.max_id + 1 - self.base(i)))


def io_chunk(budget: int, threads: int) -> int:
    return min(max(3 * budget // (20 * threads), 256 * KIB), 4 * MIB)


def usable_bytes(budget: int, threads: int) -> int:
    return max(0, budget * 85 // 100 - threads * (2 * io_chunk(budget, threads) + 512 * KIB))


def sort_fits(max_id: int, edges_raw: int, usable: int, p: int) -> bool:
    """Whether two sides of an average block fit beside what a block's vertices need."""
    ids = (max_id + 1) * p
    return 16 * edges_raw + 4 * ids - (-ids // 8) <= (usable - 8 * MIB) * p * p


def _try_plan(max_id: int, edges_raw: int, budget: int, threads: int) -> PartitionScheme | None:
    usable, r = usable_bytes(budget, threads), max_id + 1
    if usable <= 8 * MIB:  # no number of intervals lets blocks be sorted
        return None
    high = 1
    while not sort_fits(max_id, edges_raw, usable, high):
        high *= 2
    low = high // 2 + 1 if high > 1 else 1
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if sort_fits(max_id, edges_raw, usable, mid) else (mid + 1, high)
    p = min(max(-(-COLUMN_BYTES * r // usable), high), r)
    fits = COLUMN_BYTES * -(-r // p) <= usable and usable // (p * p) >= 8 * KIB
    return PartitionScheme(max_id, p) if fits else None


def min_budget(max_id: int, edges_raw: int, threads: int) -> int:
    """The least budget that a plan exists for."""
    low, high = 64 * KIB, TIB
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if _try_plan(max_id, edges_raw, mid, threads) else (mid + 1, high)
    return high


def plan(max_id: int, edges_raw: int, budget: int, threads: int) -> PartitionScheme:
    if threads < 1:
        raise GraphError(f"{threads} threads can't run a plan")
    found = _try_plan(max_id, edges_raw, budget, threads)
    if found is None:
        raise GraphError(f"no layout fits a budget of {budget} bytes (max_id={max_id}, edges={edges_raw}); it takes {min_budget(max_id, edges_raw, threads)} bytes")
    return found


def plan_or_least(max_id: int, edges_raw: int, budget: int, threads: int) -> PartitionScheme:
    """The plan for the budget, or for the least multiple of it by a power of two that has one: nothing here needs the blocks to fit."""
    while budget <= TIB:
        found = _try_plan(max_id, edges_raw, budget, threads)
        if found:
            return found
        budget *= 2
    return PartitionScheme(max_id, 1)


def rank_needs(scheme: PartitionScheme, budget: int, threads: int) -> list[tuple[str, int]]:
    """What ranking an interval against another holds in memory, in bytes."""
    vertices = scheme.interval
    return [
        ("contributions of the sources", SCORE_BYTES * vertices), ("sums of the targets", SCORE_BYTES * vertices), ("degrees", DEGREE_BYTES * vertices), ("presence", vertices // 8 + 1),
        ("a chunk of edges", io_chunk(budget, threads)), ("the block index", INDEX_BYTES * scheme.partitions**2), ("partial sums", 3 * SCORE_BYTES * -(-vertices // CHUNK_VERTICES)),
        ("lines of text", threads * CHUNK_VERTICES * LINE_BYTES),
    ]


def check_rank_budget(scheme: PartitionScheme, budget: int, threads: int) -> None:
    usable, held = budget * 85 // 100, 0
    for what, size in rank_needs(scheme, budget, threads):
        if held + size > usable:
            raise GraphError(f"memory budget exceeded: {what} take {size} bytes, {held} of {usable} are taken")
        held += size


def interval_of(vertex: Column, scheme: PartitionScheme) -> Column:
    return F.floor(vertex / scheme.interval).cast("int")


def with_blocks(edges: DataFrame, scheme: PartitionScheme) -> DataFrame:
    """Edges with their intervals and the position of their block, destination interval first."""
    placed = edges.withColumn("src_interval", interval_of(F.col("src"), scheme)).withColumn("dst_interval", interval_of(F.col("dst"), scheme))
    return placed.withColumn("block_pos", (F.col("dst_interval") * scheme.partitions + F.col("src_interval")).cast("long"))


def sorted_blocks(edges: DataFrame, scheme: PartitionScheme) -> DataFrame:
    """Edges in block order, by destination then source within a block: a range partitioning, so blocks of any size sort by spilling."""
    placed = with_blocks(edges, scheme)
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartitionByRange(n, "block_pos", "dst", "src").sortWithinPartitions("block_pos", "dst", "src")


def block_index(edges: DataFrame, scheme: PartitionScheme) -> DataFrame:
    """Every block's edge count and offset, blocks starting at multiples of 4 KiB.  The running sum has one row a block."""
    spark, p = edges.sparkSession, scheme.partitions
    every = spark.range(p * p).select(F.col("id").alias("block_pos"))
    counts = with_blocks(edges, scheme).groupBy("block_pos").agg(F.count("*").alias("edge_count"))
    filled = every.join(counts, "block_pos", "left").select("block_pos", F.coalesce("edge_count", F.lit(0)).alias("edge_count"))
    padded = F.ceil(F.col("edge_count") * EDGE_BYTES / BLOCK_ALIGN) * BLOCK_ALIGN
    before = F.coalesce(F.sum(padded).over(Window.orderBy("block_pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return filled.select((F.col("block_pos") % p).cast("int").alias("src_interval"), F.floor(F.col("block_pos") / p).cast("int").alias("dst_interval"), "block_pos", before.cast("long").alias("offset_bytes"), "edge_count")


def required_bytes(index: DataFrame) -> DataFrame:
    return index.agg(F.max(F.col("offset_bytes") + EDGE_BYTES * F.col("edge_count")).alias("required_bytes"))


def save_blocks(edges: DataFrame, scheme: PartitionScheme, path: str) -> None:
    """Edges in block order as Parquet, and the index: row groups hold runs of blocks, so one block is read by their statistics."""
    sorted_blocks(edges, scheme).select("block_pos", "src", "dst").write.mode("overwrite").parquet(f"{path}/blocks")
    block_index(edges, scheme).coalesce(1).write.mode("overwrite").parquet(f"{path}/index")


def load_index(spark: SparkSession, path: str, scheme: PartitionScheme) -> DataFrame:
    """The saved index, held against the scheme and the stored blocks."""
    index = spark.read.schema(BLOCK_INDEX).parquet(f"{path}/index")
    told = index.agg(F.count("*").alias("n"), F.countDistinct("block_pos").alias("d"), F.max("block_pos").alias("top")).first()
    if told["n"] != scheme.partitions**2 or told["d"] != told["n"] or told["top"] != told["n"] - 1:
        raise GraphError(f"{path}: the index has {told['n']} blocks, the layout {scheme.partitions**2}")
    stored = spark.read.parquet(f"{path}/blocks").groupBy("block_pos").agg(F.count("*").alias("stored"))
    wrong = index.join(stored, "block_pos", "full_outer").where("coalesce(edge_count, -1) <> coalesce(stored, 0)").limit(1).collect()
    if wrong:
        raise GraphError(f"{path}: block {wrong[0]['block_pos']} holds {wrong[0]['stored'] or 0} edges, the index says {wrong[0]['edge_count']}")
    return index


def scan_block(spark: SparkSession, path: str, scheme: PartitionScheme, src_interval: int, dst_interval: int) -> DataFrame:
    """One stored block's edges by destination, then source; the filter reaches the Parquet scan."""
    if not (0 <= src_interval < scheme.partitions and 0 <= dst_interval < scheme.partitions):
        raise GraphError(f"no block ({src_interval}, {dst_interval}) in {scheme.partitions} intervals")
    block = spark.read.parquet(f"{path}/blocks").where(F.col("block_pos") == dst_interval * scheme.partitions + src_interval)
    return block.select("src", "dst").orderBy("dst", "src")
