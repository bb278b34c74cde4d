"""Synthetic graphs with a power-law out-degree and a few very popular vertices."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.schemas import GIB, KIB, MIB, GraphError


def parse_hypernodes(text: str) -> tuple[int, int]:
    """COUNT:DEGREE."""
    m = re.fullmatch(r"([0-9]+):([0-9]+)", text)
    if not m or (int(m[1]) > 0) != (int(m[2]) > 0):
        raise GraphError(f"invalid hypernodes: '{text}'")
    return int(m[1]), int(m[2])


def parse_target_size(text: str) -> int:
    m = re.fullmatch(r"([0-9]+(?:\.[0-9]+)?)([KMGkmg]?)", text)
    size = int(float(m[1]) * {"": 1, "K": KIB, "M": MIB, "G": GIB}[m[2].upper()]) if m else 0
    if size <= 0:
        raise GraphError(f"invalid size: '{text}'")
    return size


def estimate_vertices(target_bytes: int, avg_degree: float) -> int:
    """Vertices whose edge lines fill a file of about that size; ids get longer as there are more."""
    n = 2
    for _ in range(20):
        line = 2 * len(str(max(n - 1, 1))) + 2
        n = max(2, int(target_bytes / (avg_degree * line)))
    return n


TRIES = 16


def _zeta(unit, exponent: float):
    """A draw of the zeta distribution by Devroye's rejection method; the last of TRIES tries stands (all fail once in 10^9 draws or so)."""
    power, b = -1 / (exponent - 1), 2.0 ** (exponent - 1)
    out = None
    for k in reversed(range(TRIES)):
        u, v = unit(F.lit("degree"), F.lit(k), "id"), unit(F.lit("accept"), F.lit(k), "id")
        x = F.floor(F.pow(u, F.lit(power))).cast("double")
        t = F.pow(1 + 1 / x, F.lit(exponent - 1))
        out = x if out is None else F.when(v * x * (t - 1) / (b - 1) <= t / b, x).otherwise(out)
    return out


def generate(spark: SparkSession, vertices: int, avg_degree: float, hypernodes: tuple[int, int] = (0, 0), seed: int = 42, exponent: float = 2.1) -> DataFrame:
    """``src, dst`` without self-loops; copies are left in.  Every value follows from the seed and the vertex, so partitioning changes nothing.

    Degrees follow a discrete power law (a zeta distribution, drawn by rejection), capped at half the vertices, rescaled to the mean and rounded, to none
    too.  Hubs are drawn from all vertices; each is another one.
    """
    if vertices < 2 or avg_degree <= 0:
        raise GraphError("a graph needs two vertices and a positive degree")
    count, degree = hypernodes
    if count > vertices or degree >= vertices:
        raise GraphError("hypernodes don't fit the graph")
    unit = lambda *c: (F.pmod(F.xxhash64(F.lit(seed), *c), F.lit(1 << 52)) + 1) / F.lit(float(1 << 52))
    raw = F.least(_zeta(unit, exponent), F.lit(float(max(2, vertices // 2))))
    degrees = spark.range(vertices).withColumn("raw", raw)
    mean = degrees.agg(F.avg("raw")).first()[0]
    wanted = F.least(F.round(F.col("raw") * (avg_degree / mean)), F.lit(vertices - 1)).cast("int")
    base = degrees.select(F.col("id").alias("src"), F.explode(F.when(wanted > 0, F.sequence(F.lit(1), wanted)).otherwise(F.array().cast("array<int>"))).alias("i"))
    base = base.select("src", F.floor(unit(F.lit("target"), "src", "i") * vertices).cast("long").alias("dst"))
    drawn = spark.range(vertices).select("id").orderBy(F.xxhash64(F.lit(seed), F.lit("which"), "id"), "id").limit(count).select(F.col("id").alias("dst"))
    hubs = drawn.select("dst", F.explode(F.sequence(F.lit(1), F.lit(max(degree, 1)))).alias("i")).select(F.floor(unit(F.lit("hub"), "dst", "i") * vertices).cast("long").alias("src"), "dst")
    both = base.unionByName(hubs).select(F.least("src", F.lit(vertices - 1)).cast("int").alias("src"), F.least("dst", F.lit(vertices - 1)).cast("int").alias("dst"))
    return both.where("src <> dst")
