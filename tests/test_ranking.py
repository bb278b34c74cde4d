import random
import shutil
from collections import Counter

import numpy as np
import pytest

from tarnflow import cli
from tarnflow.functions.numbers import format_rank, parse_size
from tarnflow.operators import compare, grid
from tarnflow.operators.prepare import load, parse_meta, prepare, save
from tarnflow.operators.rank import rank
from tarnflow.operators.sinks import csv_lines, rank_sum_is_one, read_csv, write_csv, write_csv_parts
from tarnflow.schemas import MIB, GraphError
from tarnflow.sources.edge_text import read_edge_text
from tarnflow.sources.generate import estimate_vertices, generate, parse_hypernodes

# The worked example, its ranks to 15 digits at the default threshold, and the exact scores of its vertices and of the ground.
EXAMPLE = [(1, 2), (2, 3), (3, 1), (4, 1)]
EXAMPLE_TEXT = "vertex,rank\n1,0.297619047574699\n2,0.273809523787349\n3,0.261904761893675\n4,0.166666666744277\n"
EXAMPLE_SCORES, EXAMPLE_GROUND = {1: 6 / 7, 2: 16 / 21, 3: 5 / 7, 4: 1 / 3}, 4 / 3
# Numbers of intervals by highest id, edges, budget in MiB and threads; the least budgets of two graphs.
PLANS = [(4847570, 68993773, 32, 8, 16), (4847570, 68993773, 64, 8, 8), (4847570, 68993773, 128, 8, 5), (41652229, 1468364884, 64, 8, 35), (41652229, 1468364884, 128, 8, 22), (4, 4, 128, 1, 1), (1999999, 23746953, 128, 8, 3)]
LEAST = {(41652229, 1468364884, 8): 46212279, (4, 4, 1): 16205268}

CASES = {
    "worked example": EXAMPLE,
    "ring of five": [(i, (i + 1) % 5) for i in range(5)],
    "all to one": [(i, 40) for i in range(12)],
    "one to all": [(40, i) for i in range(12)],
    "path": [(10, 20), (20, 30), (30, 40)],
    "two parts": [(1, 2), (2, 1), (7, 8), (8, 9), (9, 7)],
    "loops and copies": [(3, 3), (3, 6), (6, 3), (6, 6), (3, 6), (6, 9), (6, 9)],
    "one edge": [(5, 2)],
    "both ways": [(a, b) for a in range(6) for b in range(6) if (a + 2 * b) % 5],
    "popular vertex": [(i, 0) for i in range(1, 300)] + [(i, i + 1) for i in range(1, 50)],
}


def edges(spark, rows):
    return spark.createDataFrame(rows, "src int, dst int")


def solve(rows):
    """Ranks by solving the stationary equations with a ground vertex."""
    e = {(a, b) for a, b in rows if a != b}
    ids = sorted({x for p in e for x in p})
    n, at = len(ids), {v: i for i, v in enumerate(ids)}
    p = np.zeros((n + 1, n + 1))
    out = {v: [b for a, b in e if a == v] for v in ids}
    for v in ids:
        for t in [at[b] for b in out[v]] + [n]:
            p[t, at[v]] = 1 / (len(out[v]) + 1)
    p[:n, n] = 1 / n
    a = np.vstack([p - np.eye(n + 1), np.ones(n + 1)])
    s = np.linalg.lstsq(a, np.append(np.zeros(n + 1), n), rcond=None)[0]
    return {v: (s[at[v]] + s[n] / n) / n for v in ids}


def ranks_of(result):
    return {r["vertex"]: r["rank"] for r in result.ranks.collect()}


@pytest.mark.parametrize("name", CASES)
def test_against_dense_solution(spark, name):
    graph, want = prepare(edges(spark, CASES[name])), solve(CASES[name])
    got = ranks_of(rank(graph, eps=1e-11))
    assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-6 for v in want)
    assert abs(sum(got.values()) - 1) < 1e-9


def test_example_text_and_iterations(spark, tmp_path):
    out = rank(prepare(edges(spark, EXAMPLE)))
    assert out.iterations == 30 and out.converged and out.trace.count() == 30
    path = tmp_path / "ranks.csv"
    write_csv(out.ranks, str(path))
    assert path.read_text() == EXAMPLE_TEXT
    assert compare.mismatches(read_csv(spark, str(path)), out.ranks).count() == 0
    assert sorted(r["line"] for r in csv_lines(out.ranks).collect()) == path.read_text().split()[1:]
    write_csv_parts(out.ranks, str(tmp_path / "parts"))
    assert compare.mismatches(read_csv(spark, str(tmp_path / "parts")), out.ranks).count() == 0
    assert rank_sum_is_one(out.ranks)


def test_exact_scores_and_ground(spark):
    out = rank(prepare(edges(spark, EXAMPLE)), eps=1e-11)
    assert abs(out.ground - EXAMPLE_GROUND) < 1e-9
    got = {r["id"]: r["s"] for r in out.scores.collect()}
    assert all(abs(got[i] - x) < 1e-9 for i, x in EXAMPLE_SCORES.items())


WAYS = {"one task": {}, "broadcast": {"local_edges": 0}, "shuffle": {"local_edges": 0, "broadcast_vertices": 0}, "exact": {"local_edges": 0, "exact": True}}


def random_edges(n, m, seed=5):
    rng = random.Random(seed)
    return [(rng.randrange(n), int(rng.random() ** 2 * n)) for _ in range(m)]


@pytest.mark.parametrize("way", WAYS)
def test_all_ways_agree_with_the_dense_solution(spark, way):
    rows = random_edges(60, 400)
    want = solve(rows)
    lines = []
    out = rank(prepare(edges(spark, rows)), 1e-6, log=lines.append, **WAYS[way])
    assert out.converged and all(abs(x - want[v]) < 1e-5 for v, x in ranks_of(out).items())
    assert len(lines) == out.iterations == out.trace.count() and lines[0].startswith("iteration 1: L1/N=")
    last = out.trace.orderBy("iteration").collect()[-1]
    assert last["ground"] == out.ground and last["l1_per_vertex"] == out.delta and abs(last["mass"] + out.ground - 60) < 1e-9


@pytest.mark.parametrize("way", ["one task", "exact"])
def test_bits_do_not_depend_on_partitions(spark, way):
    """Scores, ground, change and mass of a graph with a vertex that blocks of sources point to, dealt out differently."""
    rows = random_edges(300, 900) + [(i, 7) for i in range(0, 20_000, 3)]
    seen = set()
    for parts in (1, 3, 7):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        out = rank(prepare(edges(spark, rows).repartition(parts)), eps=0.0, max_iters=2, **WAYS[way])
        scores = tuple(sorted((r["id"], r["s"]) for r in out.scores.collect()))
        seen.add((scores, tuple((r["l1_per_vertex"], r["ground"], r["mass"]) for r in out.trace.orderBy("iteration").collect())))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert len(seen) == 1


def _above_edges(plan):
    """What a step does to the bucketed edges before it joins them with the contributions."""
    lines = plan.split("\n")
    at = next(i for i, line in enumerate(lines) if "Bucketed: true" in line)
    join = max(i for i in range(at) if "Join" in lines[i])
    return "\n".join(lines[join + 1 : at])


def test_steps_do_not_shuffle_edges(spark):
    from tarnflow.materialise import Stage
    from tarnflow.operators.rank import initial_state, step

    graph = prepare(edges(spark, random_edges(500, 3000)))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        by_dst, by_src = Stage(graph.edges, "e", "dst", 8), Stage(graph.edges, "e", "src", 8)
        state = initial_state(graph.vertices)
        plans = {b: step(e.df, state, 0.0, 500, b)._jdf.queryExecution().executedPlan().toString() for b, e in ((True, by_dst), (False, by_src))}
        # Edges never move.  While contributions are broadcast the sums by target don't either; beyond, contributions and partial sums do.
        assert all("Exchange" not in _above_edges(p) for p in plans.values())
        assert [plans[b].count("Exchange hashpartitioning") for b in (True, False)] == [1, 3]
        by_dst.drop()
        by_src.drop()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_transpose_swaps_degrees(spark):
    rows = random_edges(60, 400)
    g, back = prepare(edges(spark, rows)), prepare(edges(spark, [(b, a) for a, b in rows]), transposed=True)
    assert (back.meta["edges"], back.meta["max_in_degree"], back.meta["max_out_degree"], back.meta["transpose"]) == (g.meta["edges"], g.meta["max_out_degree"], g.meta["max_in_degree"], 1)


def test_not_converged(spark):
    g = prepare(edges(spark, EXAMPLE))
    out = rank(g, max_iters=2)
    assert not out.converged and out.iterations == 2
    none = rank(g, max_iters=0)
    assert none.iterations == 0 and all(abs(x - 0.25) < 1e-15 for x in ranks_of(none).values())


MIXED = [(4, 11), (11, 4), (4, 11), (6, 6), (2, 6), (6, 2), (2, 6), (2, 6), (13, 13), (0, 4)]


def _spoil(spark, path, table, change):
    rows = spark.read.parquet(f"{path}/{table}")
    change(rows).write.parquet(f"{path}/spoilt")
    shutil.rmtree(f"{path}/{table}")
    shutil.move(f"{path}/spoilt", f"{path}/{table}")


def test_report_save_and_load(spark, tmp_path):
    lines = []
    g = prepare(edges(spark, MIXED), log=lines.append)
    assert {(r["src"], r["dst"]) for r in g.edges.collect()} == {(4, 11), (11, 4), (2, 6), (6, 2), (0, 4)}
    m = g.meta
    assert (m["dropped_self_loops"], m["dropped_duplicates"], m["vertices"], m["edges_raw"], m["max_id"]) == (2, 3, 5, 10, 13)
    assert lines[0] == "scan: max_id=13 edges=10" and lines[-1].startswith("degrees: vertices=5")
    save(g, str(tmp_path / "g"))
    again = load(spark, str(tmp_path / "g"))
    assert again.meta == m and ranks_of(rank(again, max_iters=3)) == ranks_of(rank(g, max_iters=3))
    with pytest.raises(GraphError, match="cannot open"):
        load(spark, str(tmp_path / "none"))


SPOILT = {
    "an edge less": ("edges", lambda e: e.where("src <> 0"), "does not hold"),
    "another edge": ("edges", lambda e: e.selectExpr("if(src = 0, 2, src) AS src", "dst"), "was changed"),
    "a degree": ("vertices", lambda v: v.selectExpr("id", "if(id = 2, 3, out_degree) AS out_degree", "in_degree"), "does not hold"),
    "degrees swapped": ("vertices", lambda v: v.selectExpr("id", "CASE id WHEN 0 THEN 0 WHEN 13 THEN 1 ELSE out_degree END + if(id = 2, 1, 0) AS out_degree", "in_degree"), "was changed|does not hold"),
    "an id": ("vertices", lambda v: v.selectExpr("if(id = 0, 1, id) AS id", "out_degree", "in_degree"), "was changed"),
    "a column": ("vertices", lambda v: v.drop("in_degree"), "has the columns"),
    "a type": ("edges", lambda e: e.selectExpr("cast(src AS long) AS src", "dst"), "has the columns"),
}


@pytest.mark.parametrize("what", SPOILT)
def test_spoilt_graphs_are_refused(spark, tmp_path, what):
    table, change, message = SPOILT[what]
    path = str(tmp_path / "g")
    save(prepare(edges(spark, MIXED)), path)
    _spoil(spark, path, table, change)
    with pytest.raises(GraphError, match=message):
        load(spark, path)


def test_stored_blocks(spark, tmp_path):
    rows = {(a, b) for a, b in random_edges(90, 700) if a != b}
    scheme, path = grid.PartitionScheme(89, 4), str(tmp_path / "b")
    grid.save_blocks(edges(spark, rows), scheme, path)
    index = {(r["src_interval"], r["dst_interval"]): r["edge_count"] for r in grid.load_index(spark, path, scheme).collect()}
    for i in range(4):
        for j in range(4):
            want = sorted(((b, a) for a, b in rows if a // 23 == i and b // 23 == j))
            got = [(r["dst"], r["src"]) for r in grid.scan_block(spark, path, scheme, i, j).collect()]
            assert got == want and index[i, j] == len(want)
    assert "PushedFilters: [IsNotNull(block_pos), EqualTo(block_pos,9)]" in grid.scan_block(spark, path, scheme, 1, 2)._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(GraphError, match="the index has 16 blocks"):
        grid.load_index(spark, path, grid.PartitionScheme(89, 5))
    with pytest.raises(GraphError, match="no block"):
        grid.scan_block(spark, path, scheme, 4, 0)
    _spoil(spark, path, "blocks", lambda b: b.where("NOT (block_pos = 5 AND src % 2 = 0)"))
    with pytest.raises(GraphError, match="block 5 holds"):
        grid.load_index(spark, path, scheme)


@pytest.mark.parametrize("rows, message", [([(5, 5), (6, 6)], "graph is empty after dropping"), ([], "contains no edges"), ([(0, 1_000_000)], "ids are sparse"), ([(None, 1)], "null or negative"), ([(-1, 1)], "null or negative")])
def test_rejected(spark, rows, message):
    with pytest.raises(GraphError, match=message):
        prepare(edges(spark, rows))


def test_meta_errors():
    with pytest.raises(GraphError, match="missing key"):
        parse_meta("{}")
    good = dict.fromkeys("transpose threads_planned max_id partitions vertices edges_raw edges dropped_self_loops dropped_duplicates max_out_degree max_in_degree".split(), 1)
    import json

    assert parse_meta(json.dumps(good | {"extra": 1}))["edges"] == 1
    for bad, message in (("x", "not a number"), (-1, "out of range")):
        with pytest.raises(GraphError, match=message):
            parse_meta(json.dumps(good | {"edges": bad}))
    with pytest.raises(GraphError, match="positive"):
        parse_meta(json.dumps(good | {"partitions": 0}))


def test_layout(spark):
    s = grid.PartitionScheme(4, 2)
    assert (s.interval, s.base(1), s.length(0), s.length(1)) == (3, 3, 3, 2)
    assert grid.PartitionScheme(4, 1).interval == 5 and grid.PartitionScheme(9, 3).interval == 4 and grid.PartitionScheme(4, 4).length(3) == 0
    index = grid.block_index(edges(spark, EXAMPLE), s).orderBy("block_pos").collect()
    assert [r["offset_bytes"] for r in index] == [0, 4096, 8192, 12288] and [r["edge_count"] for r in index] == [1, 2, 1, 0]
    one = grid.block_index(edges(spark, [(0, 4)]), grid.PartitionScheme(8, 3)).where("edge_count > 0").collect()
    assert [(r["src_interval"], r["dst_interval"]) for r in one] == [(0, 1)]
    rows = [(8, 3), (0, 5), (6, 3), (2, 5), (1, 3), (9, 0)]
    assert [(r["src"], r["dst"]) for r in grid.sorted_blocks(edges(spark, rows), grid.PartitionScheme(9, 1)).collect()] == [(9, 0), (1, 3), (6, 3), (8, 3), (0, 5), (2, 5)]


@pytest.mark.parametrize("max_id, m, mib, threads, p", PLANS)
def test_planner(max_id, m, mib, threads, p):
    assert grid.plan(max_id, m, mib * MIB, threads).partitions == p


def test_planner_limits(spark):
    for (max_id, m, threads), least in LEAST.items():
        assert grid.min_budget(max_id, m, threads) == least
        assert grid.plan(max_id, m, least, threads) and grid.plan_or_least(max_id, m, least, threads) == grid.plan(max_id, m, least, threads)
        assert grid.plan_or_least(max_id, m, MIB, threads) == grid.plan(max_id, m, 64 * MIB if max_id > 4 else 16 * MIB, threads)
        with pytest.raises(GraphError, match=f"it takes {least} bytes"):
            grid.plan(max_id, m, least - 1, threads)
    with pytest.raises(GraphError, match="0 threads"):
        grid.plan(4, 4, 128 * MIB, 0)
    # A budget is no limit of the library: only strict preparation refuses.
    few = edges(spark, EXAMPLE)
    assert prepare(few, budget_bytes=MIB).meta["partitions"] == 1
    with pytest.raises(GraphError, match="no layout fits"):
        prepare(few, budget_bytes=MIB, strict=True)
    assert grid.plan_or_least(2147483647, 100_000_000_000, 128 * MIB, 8).partitions > 1


def test_rank_budget():
    scheme = grid.PartitionScheme(1_999_999, 3)
    grid.check_rank_budget(scheme, 128 * MIB, 8)
    needs = sum(n for _, n in grid.rank_needs(scheme, 20 * MIB, 1))
    grid.check_rank_budget(scheme, needs * 100 // 85 + 1, 1) if grid.io_chunk(needs * 100 // 85 + 1, 1) <= grid.io_chunk(20 * MIB, 1) else None
    with pytest.raises(GraphError, match="memory budget exceeded"):
        grid.check_rank_budget(scheme, 8 * MIB, 1)


def test_numbers():
    assert parse_size("128M") == 128 * MIB and parse_size("3k") == 3072 and format_rank(0.25) == "0.25"
    for bad in ("", "0", "1T", "-1", "1.5M", "M"):
        with pytest.raises(GraphError):
            parse_size(bad)


def test_compare(spark):
    a = spark.createDataFrame([(1, 0.5), (2, 0.3), (3, 0.2)], "vertex int, rank double")
    b = spark.createDataFrame([(1, 0.5), (2, 0.2), (4, 0.3)], "vertex int, rank double")
    d = compare.difference(a, b).first()
    assert (d["both"], d["one_only"]) == (2, 2) and abs(d["max_abs_diff"] - 0.1) < 1e-12
    assert compare.top_k_overlap(a, b, 2).first()[0] == 1
    assert abs(compare.spearman(a, a).first()[0] - 1) < 1e-12
    ties = spark.createDataFrame([(1, 0.5), (2, 0.25), (3, 0.25)], "vertex int, rank double")
    assert {r["vertex"]: r["place"] for r in compare.average_places(ties).collect()} == {1: 1.0, 2: 2.5, 3: 2.5}


def test_generator(spark):
    one = generate(spark, 500, 6.0, (2, 50), 7)
    two = generate(spark, 500, 6.0, (2, 50), 7).repartition(3)
    assert one.exceptAll(two).count() == 0 and two.exceptAll(one).count() == 0
    assert one.where("src = dst OR src < 0 OR src >= 500 OR dst < 0 OR dst >= 500").count() == 0
    assert generate(spark, 500, 6.0, (2, 50), 8).exceptAll(one).count() > 0
    assert parse_hypernodes("3:50000") == (3, 50000) and estimate_vertices(10_000_000, 12) > 10_000
    for bad in ("3", "a:b", "0:5", "-1:2"):
        with pytest.raises(GraphError):
            parse_hypernodes(bad)
    with pytest.raises(GraphError):
        generate(spark, 1, 2.0)


def test_generated_degrees(spark):
    n = 4000
    edges_ = generate(spark, n, 8.0, (2, 900), 3)
    out, into = Counter(r["src"] for r in edges_.collect()), Counter(r["dst"] for r in edges_.collect())
    assert abs(sum(out.values()) / n - 8.45) < 0.4 and max(out.values()) <= n - 1
    assert generate(spark, n, 0.5).select("src").distinct().count() < n / 2
    hubs = [v for v, m in into.items() if m > 850]
    assert len(hubs) == 2 and set(hubs) != {0, 1}
    raw = generate(spark, 20_000, 100.0, (0, 0), 4)
    counts = Counter(Counter(r["src"] for r in raw.collect()).values())
    low = min(counts)
    # Of a zeta law most draws are 1, which the scale makes the least degree.
    assert counts[low] + counts[low + 1] > 0.5 * sum(counts.values())


def test_read_csv_checks_the_order(spark, tmp_path):
    for name, text, good in (("up", "1,0.5\n2,0.25\n9,0.25\n", True), ("down", "1,0.5\n9,0.25\n2,0.25\n", False), ("twice", "1,0.5\n1,0.5\n", False), ("text", "1,0.5\nx,0.5\n", False)):
        (tmp_path / name).write_text("vertex,rank\n" + text)
        if good:
            assert read_csv(spark, str(tmp_path / name)).count() == 3
        else:
            with pytest.raises(GraphError):
                read_csv(spark, str(tmp_path / name))
    long = "vertex,rank\n" + "".join(f"{i},0.1\n" for i in range(5000))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        (tmp_path / "long").write_text(long)
        assert read_csv(spark, str(tmp_path / "long")).count() == 5000
        (tmp_path / "long2").write_text(long + "4,0.1\n")
        with pytest.raises(GraphError, match="ascend"):
            read_csv(spark, str(tmp_path / "long2"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "e.csv").write_text("a,b\n" + "".join(f"{x},{y}\n" for x, y in EXAMPLE))
    folder, out = str(tmp_path / "w"), str(tmp_path / "r.csv")
    run = lambda *args: cli.main([*args], spark)
    assert run("prepare", str(tmp_path / "e.csv"), folder, "--budget", "128M") == 0
    assert run("rank", folder, "--budget", "128M", "--out", out) == 0 and open(out).read() == EXAMPLE_TEXT
    assert run("rank", folder, "--budget", "128M", "--out", out, "--max-iters", "2") == 0
    said = capsys.readouterr()
    assert "WARNING: not settled after 2 steps" in said.err and "done: iterations=2 converged=false" in said.out
    assert run("rank", folder, "--budget", "128M", "--out", str(tmp_path / "parts"), "--parts") == 0
    assert compare.mismatches(read_csv(spark, str(tmp_path / "parts")), rank(load(spark, folder)).ranks).count() == 0
    for bad in (
        ("rank", folder, "--budget", "128M", "--out", out, "--threads", "9"), ("rank", folder, "--budget", "512K", "--out", out), ("prepare", str(tmp_path / "missing.csv"), folder, "--budget", "128M"),
        ("prepare", str(tmp_path / "e.csv"), folder, "--budget", "1M"), ("rank",), ("rank", folder, "--budget", "0", "--out", out), (),
    ):
        assert run(*bad) == 1 and capsys.readouterr().err


def test_cli_generate(spark, tmp_path):
    folder = str(tmp_path / "g")
    assert cli.main(["generate", "--vertices", "300", "--avg-degree", "4", "--hypernodes", "2:100", "--seed", "6", "--out", folder], spark) == 0
    assert read_edge_text(spark, folder).exceptAll(generate(spark, 300, 4.0, (2, 100), 6)).count() == 0
    assert cli.main(["generate", "--target-size", "20K", "--avg-degree", "4", "--out", folder], spark) == 0
    size = sum(p.stat().st_size for p in (tmp_path / "g").glob("part-*"))
    assert 10_000 < size < 40_000
