"""Influence scores: a random walk over the edges and a ground vertex joined to all, iterated until it settles."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tarnflow.materialise import Stage
from tarnflow.operators.prepare import PreparedGraph
from tarnflow.schemas import EPS, MASS_TOLERANCE, MAX_ITERS, TRACE, GraphError

#: Contributions (16 bytes a vertex, about) are broadcast up to so many vertices; beyond, edges join them by shuffle.
BROADCAST_VERTICES = 2_000_000
#: Graphs of so many edges at most (16 bytes each while iterating) are iterated in one task: a job a step would cost more than the step.
LOCAL_EDGES = 4_000_000
#: Edges of a bucket, about, of the table that the steps read.
BUCKET_EDGES = 4_000_000
#: Ids whose values are summed up in order at once, as a power of two.
BLOCK_BITS = 12


@dataclass
class RankResult:
    """``ranks`` (vertex, rank), ``scores`` (id, k, s), and how the iteration ended."""

    ranks: DataFrame
    scores: DataFrame
    ground: float
    iterations: int
    converged: bool
    delta: float
    trace: DataFrame


def initial_state(vertices: DataFrame) -> DataFrame:
    return vertices.select("id", F.col("out_degree").alias("k"), F.lit(1.0).alias("s"))


def contribution() -> Column:
    """What a vertex gives to each target and to the ground."""
    return F.col("s") / (F.col("k") + F.lit(1.0))


def incoming(edges: DataFrame, state: DataFrame, broadcast: bool) -> DataFrame:
    """Sums of contributions by target; sums within a task come before the shuffle, so a popular target is a row a task."""
    given = state.where("k > 0").select(F.col("id").alias("src"), contribution().alias("c"))
    return edges.join(F.broadcast(given) if broadcast else given, "src").groupBy(F.col("dst").alias("id")).agg(F.sum("c").alias("x"))


def _folded(rows: DataFrame, keys: list[str], at: str, columns: list[str]) -> DataFrame:
    """Sums of ``columns`` by ``keys`` over blocks of the number ``at``, which becomes the block's, added in its order: at most 2 ** BLOCK_BITS values at once."""
    block = F.shiftright(F.col(at), BLOCK_BITS)
    ordered = rows.groupBy(*keys, block.alias(at)).agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("_at"), *columns))).alias("_all"))
    total = lambda c: F.aggregate("_all", F.lit(0.0), lambda a, x: a + x[c]).alias(c)
    return ordered.select(*keys, at, *map(total, columns))


def ordered_sums(rows: DataFrame, keys: list[str], at: str, columns: list[str]) -> DataFrame:
    """Sums of doubles that don't depend on partitions: added in the order of the ids ``at``, block by block, then blocks of blocks.

    Ids have 31 bits, so three rounds leave one row a key, and neither a popular target nor a sum over all vertices is in one row's memory.
    """
    for _ in range(3):
        rows = _folded(rows, keys, at, columns)
    return rows.select(*keys, *columns)


def exact_incoming(edges: DataFrame, state: DataFrame) -> DataFrame:
    """Sums added in an order fixed by the sources' ids."""
    given = state.where("k > 0").select(F.col("id").alias("src"), contribution().alias("x"))
    return ordered_sums(edges.join(given, "src").select(F.col("dst").alias("id"), "src", "x"), ["id"], "src", ["x"])


def step(edges: DataFrame, state: DataFrame, ground: float, n: int, broadcast: bool = True, exact: bool = False) -> DataFrame:
    """The next state, with the scores it came from in ``old``."""
    sums = exact_incoming(edges, state) if exact else incoming(edges, state, broadcast)
    new = F.coalesce("x", F.lit(0.0)) + F.lit(ground / n)
    return state.join(sums, "id", "left").select("id", "k", new.alias("s"), F.col("s").alias("old"))


def final_ranks(state: DataFrame, ground: float, n: int) -> DataFrame:
    return state.select(F.col("id").alias("vertex"), ((F.col("s") + F.lit(ground / n)) / F.lit(float(n))).alias("rank"))


def solve(src: np.ndarray, dst: np.ndarray, eps: float, max_iters: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[float, float, float]]]:
    """Ids, out-degrees, scores and each step's mean change, ground and mass.  Edges are added in the order of target and source."""
    order = np.lexsort((src, dst))
    ids, place = np.unique(np.concatenate([src[order], dst[order]]), return_inverse=True)
    a, b, n = place[: len(src)], place[len(src) :], len(ids)
    k = np.bincount(a, minlength=n)
    s, ground, steps = np.ones(n), 0.0, []
    for _ in range(max_iters):
        c = s / (k + 1.0)
        new = np.bincount(b, weights=c[a], minlength=n) + ground / n
        ground = float(c.sum())
        steps.append((float(np.abs(new - s).sum()) / n, ground, float(new.sum())))
        s = new
        if steps[-1][0] < eps:
            break
    return ids, k, s, steps


def _solve_here(eps: float, max_iters: int):
    def run(batches):
        pairs = [(b.column("src").to_numpy(), b.column("dst").to_numpy()) for b in batches]
        if pairs:
            ids, k, s, steps = solve(*(np.concatenate(x) for x in zip(*pairs)), eps, max_iters)
            none = pa.nulls(len(ids), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(ids), pa.int32()), pa.array(ids, pa.int32()), pa.array(k, pa.int32()), pa.array(s), none, none], ["step", "id", "k", "s", "ground", "mass"])
            delta, ground, mass = (pa.array([x[i] for x in steps], pa.float64()) for i in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(range(1, len(steps) + 1), pa.int32()), pa.nulls(len(steps), pa.int32()), pa.nulls(len(steps), pa.int32()), delta, ground, mass], ["step", "id", "k", "s", "ground", "mass"])

    return run


def _mass_holds(mass: float, ground: float, n: int) -> None:
    off = abs(mass + ground - n)
    if not off <= MASS_TOLERANCE * n:
        raise GraphError(f"scores don't add up: {mass} and {ground} of the ground are {off} off {n}")


def rank(
    graph: PreparedGraph, eps: float = EPS, max_iters: int = MAX_ITERS, exact: bool = False, broadcast_vertices: int = BROADCAST_VERTICES, local_edges: int = LOCAL_EDGES, log: Callable[[str], None] | None = None
) -> RankResult:
    """Iterate until the mean change of a score is below ``eps`` (never for eps <= 0) or ``max_iters`` steps are done.

    Up to ``local_edges`` edges one task does all steps; its sums are in an order fixed by the ids.  Beyond, a step is one job: it writes the new state to
    the shared folder, so plans don't grow and a lost executor repeats one step at most.  Edges are written once in buckets, which no step shuffles: by
    target while the contributions are broadcast, so their sums need no shuffle at all; by source beyond ``broadcast_vertices``, so only contributions
    and partial sums move.  ``exact`` makes a step's sums independent of partitions, at the cost of shuffling what is summed.
    """
    spark, n, m = graph.edges.sparkSession, graph.meta["vertices"], graph.meta["edges"]
    if n == 0:
        raise GraphError("graph is empty after dropping self-loops and duplicates")
    say = log or (lambda line: None)
    told = lambda i, delta, ground, seconds: say(f"iteration {i}: L1/N={delta:.3e} s_g={ground:.6f} time={seconds:.3f}s")
    if m <= local_edges:
        began = time.time()
        done = Stage(graph.edges.coalesce(1).mapInArrow(_solve_here(eps, max_iters), "step int, id int, k int, s double, ground double, mass double"), "scores").df
        steps = done.where("step IS NOT NULL").orderBy("step").collect()  # max_iters at most
        each = (time.time() - began) / max(1, len(steps))
        trace = [(r["step"], r["s"], r["ground"], r["mass"], each) for r in steps]
        for i, delta, ground, mass, seconds in trace:
            _mass_holds(mass, ground, n)
            told(i, delta, ground, seconds)
        delta, ground = (trace[-1][1], trace[-1][2]) if trace else (float("inf"), 0.0)
        state = done.where("id IS NOT NULL").select("id", "k", "s")
        return RankResult(final_ranks(state, ground, n), state, ground, len(trace), delta < eps, delta, spark.createDataFrame(trace, TRACE))
    cast = n <= broadcast_vertices and not exact
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-m // BUCKET_EDGES))
    edges = Stage(graph.edges, "bucketed-edges", "dst" if cast else "src", buckets)
    state, ground, delta, trace, converged, kept = initial_state(graph.vertices), 0.0, float("inf"), [], False, None
    for i in range(1, max_iters + 1):
        began = time.time()
        fresh = step(edges.df, state, ground, n, cast, exact)
        moved, given = F.abs(F.col("s") - F.col("old")), F.col("old") / (F.col("k") + F.lit(1.0))
        if exact:
            written = Stage(fresh, "scores")
            parts = written.df.select(F.lit(0).alias("one"), F.col("id").alias("at"), moved.alias("moved"), F.col("s").alias("mass"), given.alias("ground"))
            sums = ordered_sums(parts, ["one"], "at", ["moved", "mass", "ground"]).first().asDict()
        else:
            # The sums are made in the job's last stage, whose tasks count once however often they run.
            seen = Observation()
            written = Stage(fresh.observe(seen, F.sum(moved).alias("moved"), F.sum("s").alias("mass"), F.sum(given).alias("ground")).select("id", "k", "s"), "scores")
            sums = seen.get
        ground, delta = sums["ground"], sums["moved"] / n
        _mass_holds(sums["mass"], ground, n)
        trace.append((i, delta, ground, sums["mass"], time.time() - began))
        told(i, delta, ground, trace[-1][4])
        if kept:
            kept.drop()
        state, kept = written.df.select("id", "k", "s"), written
        if delta < eps:
            converged = True
            break
    edges.drop()
    return RankResult(final_ranks(state, ground, n), state, ground, len(trace), converged, delta, spark.createDataFrame(trace, TRACE))
