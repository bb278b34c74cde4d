"""From raw edges to a clean simple graph with degrees and a report."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.materialise import Stage
from tarnflow.operators.grid import PartitionScheme, plan, plan_or_least
from tarnflow.schemas import EDGE, MAX_ID, META, MIB, SPARSE_RATIO, VERTEX, GraphError

META_KEYS = [field.split()[0] for field in META.split(", ")]


@dataclass
class PreparedGraph:
    """Distinct loop-free ``edges``, ``vertices`` with both degrees, and the report."""

    edges: DataFrame
    vertices: DataFrame
    meta: dict[str, int]

    @property
    def scheme(self) -> PartitionScheme:
        return PartitionScheme(self.meta["max_id"], self.meta["partitions"])


def scan_stats(edges: DataFrame) -> DataFrame:
    """One row over the raw edges: edges_raw, max_id, self_loops, edges_written and invalid ids."""
    bad = F.col("src").isNull() | F.col("dst").isNull() | (F.least("src", "dst") < 0) | (F.greatest("src", "dst") > MAX_ID)
    return edges.agg(
        F.count("*").alias("edges_raw"), F.max(F.greatest("src", "dst")).alias("max_id"), F.count_if(F.col("src") == F.col("dst")).alias("self_loops"),
        F.count_if(F.col("src") != F.col("dst")).alias("edges_written"), F.count_if(bad).alias("invalid"),
    )


def clean(edges: DataFrame) -> DataFrame:
    """Distinct edges without self-loops: one shuffle, copies collapsed before it."""
    return edges.where("src <> dst").select("src", "dst").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """``id, out_degree, in_degree`` of each end of a clean edge, zero where it has none: one aggregation over both ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.o").cast("int").alias("out_degree"), F.sum("e.i").cast("int").alias("in_degree"))


def check_scan(stats, allow_sparse: bool) -> None:
    if stats["edges_raw"] == 0:
        raise GraphError("input file contains no edges")
    if stats["invalid"]:
        raise GraphError(f"{stats['invalid']} edges have a null or negative id")
    if not allow_sparse and stats["max_id"] + 1 > SPARSE_RATIO * stats["edges_raw"]:
        raise GraphError(f"ids are sparse: {stats['edges_raw']} edges are few for ids up to {stats['max_id']}; number the vertices without gaps")


def prepare(edges: DataFrame, budget_bytes: int = 128 * MIB, threads: int = 8, transposed: bool = False, allow_sparse: bool = False, strict: bool = False, log: Callable[[str], None] | None = None) -> PreparedGraph:
    """Clean raw ``src, dst`` edges; edges and vertices are written once and read by every later step.

    Ids may be sparse here without cost; ``allow_sparse`` leaves out the check that the dense layout needs.  The layout of blocks is planned for a
    budget of memory that nothing here is bound by; only with ``strict`` is a graph refused that no layout fits.
    """
    say = log or (lambda line: None)
    stats = scan_stats(edges).first()
    check_scan(stats, allow_sparse)
    say(f"scan: max_id={stats['max_id']} edges={stats['edges_raw']}")
    scheme = (plan if strict else plan_or_least)(stats["max_id"], stats["edges_raw"], budget_bytes, threads)
    say(f"partitioning: P={scheme.partitions} interval={scheme.interval}")
    say(f"scatter: edges={stats['edges_written']} self_loops_dropped={stats['self_loops']}")
    kept = Stage(clean(edges), "clean-edges").df
    vertices = Stage(degrees(kept), "degrees").df
    own = vertices.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("out_degree").cast("long")), F.lit(0)).alias("m"), F.max("out_degree").alias("o"), F.max("in_degree").alias("i")).first()
    say(f"assemble: duplicates_dropped={stats['edges_written'] - own['m']} max_in_degree={own['i'] or 0}")
    if own["n"] == 0:
        raise GraphError("graph is empty after dropping self-loops and duplicates")
    say(f"degrees: vertices={own['n']} max_out_degree={own['o']}")
    meta = dict(zip(META_KEYS, (int(transposed), threads, stats["max_id"], scheme.partitions, own["n"], stats["edges_raw"], own["m"], stats["self_loops"], stats["edges_written"] - own["m"], own["o"], own["i"])))
    return PreparedGraph(kept, vertices, meta)


def report(spark: SparkSession, graph: PreparedGraph) -> DataFrame:
    return spark.createDataFrame([tuple(graph.meta[k] for k in META_KEYS)], META)


def checksum(rows: DataFrame) -> str:
    """A sum over all rows that a changed, lost or repeated row changes, in any order."""
    return str(rows.agg(F.sum(F.xxhash64(*rows.columns).cast("decimal(20,0)"))).first()[0] or 0)


def save(graph: PreparedGraph, path: str) -> None:
    """Edges and vertices as Parquet, the report last: without it the folder is no graph.  Only these three folders are replaced."""
    spark = graph.edges.sparkSession
    graph.edges.write.mode("overwrite").parquet(f"{path}/edges")
    graph.vertices.write.mode("overwrite").parquet(f"{path}/vertices")
    told = graph.meta | {"edges_sum": checksum(graph.edges.select("src", "dst")), "vertices_sum": checksum(graph.vertices.select("id", "out_degree", "in_degree"))}
    spark.createDataFrame([(json.dumps(told),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def parse_meta(text: str) -> dict[str, int]:
    """The report, checked; keys that aren't known are ignored."""
    raw = json.loads(text)
    out: dict[str, int] = {}
    for key in META_KEYS:
        if key not in raw:
            raise GraphError(f"missing key {key}")
        if isinstance(raw[key], bool) or not isinstance(raw[key], int):
            raise GraphError(f"not a number in {key}")
        if not 0 <= raw[key] < (1 << 64):
            raise GraphError(f"value out of range for {key}")
        out[key] = raw[key]
    if out["partitions"] == 0:
        raise GraphError("partitions must be positive")
    return out


def load(spark: SparkSession, path: str) -> PreparedGraph:
    """A saved graph, its columns, counts, degrees and checksums held against the report."""
    try:
        text = spark.read.text(f"{path}/meta").first()["value"]
        edges, vertices = spark.read.parquet(f"{path}/edges"), spark.read.parquet(f"{path}/vertices")
    except Exception as e:
        raise GraphError(f"cannot open {path}: {type(e).__name__}") from e
    meta = parse_meta(text)
    for name, rows, schema in (("edges", edges, EDGE), ("vertices", vertices, VERTEX)):
        if [f"{f.name} {f.dataType.simpleString().upper()}" for f in rows.schema] != schema.split(", "):
            raise GraphError(f"{path}/{name} has the columns {rows.schema.simpleString()}")
    v = vertices.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.sum("out_degree").alias("o"), F.sum("in_degree").alias("i"), F.max("out_degree").alias("mo"), F.max("in_degree").alias("mi"), F.min("id").alias("low"), F.max("id").alias("high")).first()
    found = (edges.count(), v["n"], v["ids"], v["o"], v["i"], v["mo"], v["mi"])
    if found != (meta["edges"], meta["vertices"], meta["vertices"], meta["edges"], meta["edges"], meta["max_out_degree"], meta["max_in_degree"]) or v["low"] < 0 or v["high"] > meta["max_id"]:
        raise GraphError(f"{path} does not hold the edges and vertices of its report")
    sums = json.loads(text)
    for name, rows, columns in (("edges_sum", edges, ("src", "dst")), ("vertices_sum", vertices, ("id", "out_degree", "in_degree"))):
        if name in sums and sums[name] != checksum(rows.select(*columns)):
            raise GraphError(f"{path} was changed: {name} differs from its report")
    return PreparedGraph(edges, vertices, meta)
