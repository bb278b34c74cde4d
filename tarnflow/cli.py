"""Command line: prepare, rank and generate.

    python -m tarnflow.cli prepare EDGES FOLDER --budget 128M [--threads N] [--transpose]
    python -m tarnflow.cli rank FOLDER --budget 128M --out FILE [--eps E] [--max-iters N] [--threads N] [--parts]
    python -m tarnflow.cli generate --vertices N --avg-degree D [--hypernodes C:D] [--seed S] --out FOLDER
"""

from __future__ import annotations

import argparse
import resource
import sys

from pyspark.sql import SparkSession

from tarnflow.functions.numbers import parse_size
from tarnflow.operators import grid
from tarnflow.operators import prepare as prep
from tarnflow.operators.rank import rank
from tarnflow.operators.sinks import write_csv, write_csv_parts
from tarnflow.schemas import EPS, MAX_ITERS, GraphError
from tarnflow.sources.edge_text import read_edge_text
from tarnflow.sources.generate import estimate_vertices, generate, parse_hypernodes, parse_target_size


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tarnflow")
    sub = top.add_subparsers(dest="tool", required=True)
    p = sub.add_parser("prepare")
    p.add_argument("edges")
    p.add_argument("folder")
    p.add_argument("--budget", type=parse_size, required=True)
    p.add_argument("--threads", type=int, default=1)
    p.add_argument("--transpose", action="store_true")
    r = sub.add_parser("rank")
    r.add_argument("folder")
    r.add_argument("--budget", type=parse_size, required=True)
    r.add_argument("--out", required=True)
    r.add_argument("--eps", type=float, default=EPS)
    r.add_argument("--max-iters", type=int, default=MAX_ITERS)
    r.add_argument("--threads", type=int, default=0)
    r.add_argument("--parts", action="store_true", help="write a folder of files, from the executors")
    g = sub.add_parser("generate")
    size = g.add_mutually_exclusive_group(required=True)
    size.add_argument("--vertices", type=int)
    size.add_argument("--target-size", type=parse_target_size)
    g.add_argument("--avg-degree", type=float, required=True)
    g.add_argument("--hypernodes", type=parse_hypernodes, default=(0, 0))
    g.add_argument("--seed", type=int, default=42)
    g.add_argument("--out", required=True)
    return top


def _peak_kib() -> int:
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return 1 if e.code else 0  # usage errors are errors like any other
    say = lambda line: print(line, flush=True)
    try:
        spark = spark or SparkSession.builder.appName("tarnflow").getOrCreate()
        if args.tool == "prepare":
            graph = prep.prepare(read_edge_text(spark, args.edges, args.transpose), args.budget, args.threads, args.transpose, strict=True, log=say)
            prep.save(graph, args.folder)
            say(f"done: peak_rss_kib={_peak_kib()}")
        elif args.tool == "rank":
            graph = prep.load(spark, args.folder)
            if args.threads > graph.meta["threads_planned"]:
                raise GraphError(f"{args.threads} threads are more than the {graph.meta['threads_planned']} of the plan")
            grid.check_rank_budget(graph.scheme, args.budget, graph.meta["threads_planned"])
            out = rank(graph, args.eps, args.max_iters, log=say)
            (write_csv_parts if args.parts else write_csv)(out.ranks, args.out)
            if not out.converged:
                print(f"WARNING: not settled after {out.iterations} steps: L1/N={out.delta:.3e}", file=sys.stderr)
            say(f"done: iterations={out.iterations} converged={str(out.converged).lower()} peak_rss_kib={_peak_kib()}")
        else:
            n = args.vertices or estimate_vertices(args.target_size, args.avg_degree)
            generate(spark, n, args.avg_degree, args.hypernodes, args.seed).selectExpr("src AS `from`", "dst AS `to`").write.mode("overwrite").option("header", True).csv(args.out)
    except Exception as e:
        print(f"tarnflow {args.tool}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
