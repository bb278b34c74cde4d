
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnflow.materialise import shared_dir
from tarnflow.operators import compare, grid
from tarnflow.operators.prepare import clean, degrees, prepare, report, scan_stats
from tarnflow.operators.rank import contribution, incoming, initial_state, rank, step
from tarnflow.operators.sinks import csv_lines
from tarnflow.schemas import MIB, SPARSE_RATIO
from tarnflow.session import ship_code
from tarnflow.sources.edge_text import parse_lines
from tarnflow.sources.generate import generate
from tarnflow.sources.graphs import GRAPHS

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
BLOCKS = 3

#: The graphs in DuckDB.
GRAPH_SQL = {
    "part_supp": "SELECT l_partkey::INTEGER AS src, l_suppkey::INTEGER AS dst FROM lineitem",
    "supp_part": "SELECT l_suppkey::INTEGER AS src, l_partkey::INTEGER AS dst FROM lineitem",
    "cust_supp": "SELECT o_custkey::INTEGER AS src, l_suppkey::INTEGER AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
    "cust_part": "SELECT o_custkey::INTEGER AS src, l_partkey::INTEGER AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
    "event_next": "SELECT * FROM (SELECT user_id::INTEGER AS src, (lead(user_id) OVER (ORDER BY ts, event_id))::INTEGER AS dst FROM events) WHERE dst IS NOT NULL",
}


def query(name: str, sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_code(spark)
            return f(spark, sf_dir)

        run.__name__ = name
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _clean_sql(graph: str = "part_supp") -> str:
    return f"g AS MATERIALIZED ({GRAPH_SQL[graph]}), e AS MATERIALIZED (SELECT DISTINCT src, dst FROM g WHERE src <> dst), v AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT dst FROM e)"


_EDGES = f"WITH {_clean_sql()} "
_RANGE = f"{_clean_sql()}, x AS (SELECT max(greatest(src, dst)) + 1 AS r, ((max(greatest(src, dst)) + {BLOCKS}) // {BLOCKS})::INTEGER AS l FROM g)"


def _walk(graph: str, steps: int) -> str:
    """State t(k, id, s) for every step; the ground is vertex -1."""
    return f"""WITH RECURSIVE {_clean_sql(graph)},
n AS MATERIALIZED (SELECT count(*)::DOUBLE AS n FROM v),
d AS MATERIALIZED (SELECT v.id, count(e.src) AS k FROM v LEFT JOIN e ON v.id = e.src GROUP BY v.id),
x AS MATERIALIZED (SELECT src, dst, 1.0::DOUBLE / (k + 1) AS w FROM e JOIN d ON e.src = d.id UNION ALL SELECT id, -1, 1.0::DOUBLE / (k + 1) FROM d UNION ALL SELECT -1, id, 1.0::DOUBLE / (SELECT n FROM n) FROM d),
t(k, id, s) AS (SELECT * FROM (SELECT 0 AS k, id, 1.0::DOUBLE AS s FROM v UNION ALL SELECT 0, -1, 0.0::DOUBLE)
  UNION ALL SELECT t.k + 1, x.dst, sum(t.s * x.w) FROM t JOIN x ON t.id = x.src WHERE t.k < {steps} GROUP BY t.k + 1, x.dst)"""


def _ranks_at(step: str) -> str:
    return f"SELECT id AS vertex, (s + (SELECT s FROM t WHERE id = -1 AND k = {step}) / (SELECT n FROM n)) / (SELECT n FROM n) AS rank FROM t WHERE id <> -1 AND k = {step}"


def _settled(graph: str, steps: int = 30) -> str:
    return _walk(graph, steps) + """,
tr AS (SELECT a.k AS it, sum(abs(a.s - b.s)) / (SELECT n FROM n) AS l1 FROM t a JOIN t b ON a.id = b.id AND a.k = b.k + 1 WHERE a.id <> -1 GROUP BY a.k),
st AS (SELECT min(it) AS it FROM tr WHERE l1 < 1e-9)"""


def _rounded(ranks: DataFrame) -> DataFrame:
    return ranks.select("vertex", F.round("rank", 9).alias("rank"))


def _prepared(spark, sf_dir, graph="part_supp"):
    return prepare(GRAPHS[graph](spark, sf_dir))


def _fixed(spark, sf_dir, steps, graph="part_supp", **how):
    return rank(_prepared(spark, sf_dir, graph), eps=0.0, max_iters=steps, **how)


#: The ways that graphs too large for one task are ranked.
BY_BROADCAST = {"local_edges": 0}
BY_SHUFFLE = {"local_edges": 0, "broadcast_vertices": 0}
EXACT = {"local_edges": 0, "exact": True}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_code(spark)
    return _rounded(rank(_prepared(spark, sf_dir)).ranks)


# Scans and cleaning


@query("raw_scan_stats", f"SELECT count(*) AS edges_raw, max(greatest(src, dst)) AS max_id FROM ({GRAPH_SQL['part_supp']})")
def _(spark, sf_dir):
    return scan_stats(GRAPHS["part_supp"](spark, sf_dir)).select("edges_raw", "max_id")


@query("self_loops_dropped", f"SELECT count(*) FILTER (WHERE src = dst) AS self_loops FROM ({GRAPH_SQL['part_supp']})")
def _(spark, sf_dir):
    return scan_stats(GRAPHS["part_supp"](spark, sf_dir)).select("self_loops")


@query("edges_written", f"SELECT count(*) FILTER (WHERE src <> dst) AS edges_written FROM ({GRAPH_SQL['part_supp']})")
def _(spark, sf_dir):
    return scan_stats(GRAPHS["part_supp"](spark, sf_dir)).select("edges_written")


@query("duplicates_dropped", _EDGES + "SELECT (SELECT count(*) FROM g WHERE src <> dst) - (SELECT count(*) FROM e) AS duplicates")
def _(spark, sf_dir):
    counts = GRAPHS["part_supp"](spark, sf_dir).where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("m"))
    return counts.agg(F.sum(F.col("m") - 1).alias("duplicates"))


for _name, _graph in GRAPHS.items():
    query(f"clean_edges_{_name}", f"WITH {_clean_sql(_name)} SELECT src, dst FROM e")(lambda spark, sf_dir, g=_graph: clean(g(spark, sf_dir)))


@query("clean_edges_transposed", _EDGES + "SELECT dst AS src, src AS dst FROM e")
def _(spark, sf_dir):
    return clean(GRAPHS["part_supp"](spark, sf_dir, transpose=True))


@query("vertex_set", _EDGES + "SELECT id FROM v")
def _(spark, sf_dir):
    edges = clean(GRAPHS["part_supp"](spark, sf_dir))
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


@query("out_degree", _EDGES + "SELECT src AS id, count(*)::INTEGER AS out_degree FROM e GROUP BY src")
def _(spark, sf_dir):
    return clean(GRAPHS["part_supp"](spark, sf_dir)).groupBy(F.col("src").alias("id")).agg(F.count("*").cast("int").alias("out_degree"))


@query("in_degree", _EDGES + "SELECT dst AS id, count(*)::INTEGER AS in_degree FROM e GROUP BY dst")
def _(spark, sf_dir):
    return clean(GRAPHS["part_supp"](spark, sf_dir)).groupBy(F.col("dst").alias("id")).agg(F.count("*").cast("int").alias("in_degree"))


_DEGREES = "SELECT id, (SELECT count(*) FROM e WHERE src = id)::INTEGER AS out_degree, (SELECT count(*) FROM e WHERE dst = id)::INTEGER AS in_degree FROM v"


@query("vertex_degrees", f"WITH {_clean_sql('cust_part')} " + _DEGREES)
def _(spark, sf_dir):
    return degrees(clean(GRAPHS["cust_part"](spark, sf_dir)))


def _report_sql() -> str:
    usable = int(128 * MIB * 0.85) - 8 * (2 * grid.io_chunk(128 * MIB, 8) + 512 * 1024)
    least = f"(SELECT min(p) FROM range(1, 5000) t(p) WHERE 16 * m0 + 4 * r * p + (r * p + 7) // 8 <= {usable - 8 * MIB} * p * p)"
    return f"""WITH {_clean_sql()}, q AS (SELECT count(*) AS m0, max(greatest(src, dst)) + 1 AS r FROM g)
SELECT 0 AS transpose, 8 AS threads_planned, (r - 1)::INTEGER AS max_id, least(greatest((20 * r + {usable - 1}) // {usable}, {least}), r)::INTEGER AS partitions, (SELECT count(*) FROM v) AS vertices, m0 AS edges_raw,
(SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM g WHERE src = dst) AS dropped_self_loops, (SELECT count(*) FROM g WHERE src <> dst) - (SELECT count(*) FROM e) AS dropped_duplicates,
(SELECT max(c) FROM (SELECT count(*) AS c FROM e GROUP BY src))::INTEGER AS max_out_degree, (SELECT max(c) FROM (SELECT count(*) AS c FROM e GROUP BY dst))::INTEGER AS max_in_degree FROM q"""


@query("prepare_report", _report_sql())
def _(spark, sf_dir):
    return report(spark, _prepared(spark, sf_dir))


@query("sparse_id_check", f"SELECT max(greatest(src, dst)) + 1 > {SPARSE_RATIO} * count(*) AS sparse FROM ({GRAPH_SQL['part_supp']})")
def _(spark, sf_dir):
    return scan_stats(GRAPHS["part_supp"](spark, sf_dir)).select((F.col("max_id") + 1 > SPARSE_RATIO * F.col("edges_raw")).alias("sparse"))


# Layout


def _scheme(spark, sf_dir) -> grid.PartitionScheme:
    return grid.PartitionScheme(scan_stats(GRAPHS["part_supp"](spark, sf_dir)).first()["max_id"], BLOCKS)


@query("interval_assignment", f"WITH {_RANGE} SELECT id, (id // l)::INTEGER AS interval FROM v, x")
def _(spark, sf_dir):
    return degrees(clean(GRAPHS["part_supp"](spark, sf_dir))).select("id", grid.interval_of(F.col("id"), _scheme(spark, sf_dir)).alias("interval"))


@query("interval_lengths", f"WITH {_RANGE} SELECT i::INTEGER AS interval, (i * l)::BIGINT AS base, greatest(0, least(l, r - i * l))::BIGINT AS length FROM x, range({BLOCKS}) t(i)")
def _(spark, sf_dir):
    s = _scheme(spark, sf_dir)
    return spark.createDataFrame([(i, s.base(i), s.length(i)) for i in range(s.partitions)], "interval int, base long, length long")


def _saved_blocks(spark, sf_dir) -> str:
    path = f"{shared_dir(spark)}/blocks-{uuid.uuid4().hex}"
    grid.save_blocks(clean(GRAPHS["part_supp"](spark, sf_dir)), _scheme(spark, sf_dir), path)
    return path


_BLOCK = f"SELECT src, dst, (src // l)::INTEGER AS src_interval, (dst // l)::INTEGER AS dst_interval, ((dst // l) * {BLOCKS} + src // l)::BIGINT AS block_pos FROM e, x"
_INDEX = f"""WITH {_RANGE}, b AS ({_BLOCK}), c AS (SELECT p::BIGINT AS block_pos, (SELECT count(*) FROM b WHERE block_pos = p) AS edge_count FROM range({BLOCKS * BLOCKS}) t(p)),
i AS (SELECT (block_pos % {BLOCKS})::INTEGER AS src_interval, (block_pos // {BLOCKS})::INTEGER AS dst_interval, block_pos,
  coalesce(sum((edge_count * 8 + 4095) // 4096 * 4096) OVER (ORDER BY block_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset_bytes, edge_count FROM c) """


@query("block_histogram", f"WITH {_RANGE}, b AS ({_BLOCK}) SELECT src_interval, dst_interval, count(*) AS edge_count FROM b GROUP BY ALL")
def _(spark, sf_dir):
    blocks = grid.with_blocks(clean(GRAPHS["part_supp"](spark, sf_dir)), _scheme(spark, sf_dir))
    return blocks.groupBy("src_interval", "dst_interval").agg(F.count("*").alias("edge_count"))


@query("block_index", _INDEX + "SELECT * FROM i")
def _(spark, sf_dir):
    return grid.block_index(clean(GRAPHS["part_supp"](spark, sf_dir)), _scheme(spark, sf_dir))


@query("workdir_need_bytes", _INDEX + "SELECT max(offset_bytes + 8 * edge_count)::BIGINT AS required_bytes FROM i")
def _(spark, sf_dir):
    return grid.required_bytes(grid.block_index(clean(GRAPHS["part_supp"](spark, sf_dir)), _scheme(spark, sf_dir)))


@query("sorted_block_edges", f"WITH {_RANGE}, b AS ({_BLOCK}) SELECT block_pos, src, dst, row_number() OVER (PARTITION BY block_pos ORDER BY dst, src)::BIGINT AS place FROM b")
def _(spark, sf_dir):
    blocks = grid.with_blocks(clean(GRAPHS["part_supp"](spark, sf_dir)), _scheme(spark, sf_dir))
    # Ranks within a destination, on top of the edges before it in its block: a block is never one task's.
    by_dst = blocks.groupBy("block_pos", "dst").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("block_pos").orderBy("dst").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("block_pos", "dst").orderBy("src"))
    return blocks.withColumn("own", own).join(by_dst.withColumn("before", before).drop("n"), ["block_pos", "dst"]).select("block_pos", "src", "dst", (F.col("before") + F.col("own")).cast("long").alias("place"))


@query("stored_block_scan", f"WITH {_RANGE}, b AS ({_BLOCK}) SELECT src, dst FROM b WHERE src_interval = 0 AND dst_interval = 0")
def _(spark, sf_dir):
    scheme, path = _scheme(spark, sf_dir), _saved_blocks(spark, sf_dir)
    return grid.scan_block(spark, path, scheme, 0, 0)


@query("stored_block_index", _INDEX + "SELECT * FROM i")
def _(spark, sf_dir):
    return grid.load_index(spark, _saved_blocks(spark, sf_dir), _scheme(spark, sf_dir))


@query("presence_popcount", f"WITH {_RANGE} SELECT (id // l)::INTEGER AS interval, count(*) AS present FROM v, x GROUP BY ALL")
def _(spark, sf_dir):
    ids = degrees(clean(GRAPHS["part_supp"](spark, sf_dir))).select("id", grid.interval_of(F.col("id"), _scheme(spark, sf_dir)).alias("interval"))
    maps = ids.groupBy("interval", F.expr("bitmap_bucket_number(id)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(id))").alias("bits"))
    return maps.groupBy("interval").agg(F.sum(F.expr("bitmap_count(bits)")).alias("present"))


PLANS = [(4847570, 68993773, b, 8) for b in (32, 64, 128)] + [(41652229, 1468364884, b, 8) for b in (64, 128)] + [(1999999, 23746953, 128, 8), (4, 4, 128, 1)]


def _plans_sql() -> str:
    rows = ", ".join(f"({m}::BIGINT, {e}::BIGINT, {b}::BIGINT, {t}::BIGINT)" for m, e, b, t in PLANS)
    return f"""WITH i AS (SELECT * FROM (VALUES {rows}) v(max_id, edges, mib, threads)), c AS (SELECT *, mib * 1048576 AS b, least(greatest(3 * mib * 1048576 // (20 * threads), 262144), 4194304) AS chunk FROM i),
u AS (SELECT *, greatest(0, b * 85 // 100 - threads * (2 * chunk + 524288)) AS usable FROM c)
SELECT max_id, edges, mib, threads, least(greatest((20 * (max_id + 1) + usable - 1) // usable, (SELECT min(p) FROM range(1, 2000) t(p) WHERE 16 * edges::HUGEINT + 4 * (max_id + 1) * p + ((max_id + 1) * p + 7) // 8 <= (usable - 8388608)::HUGEINT * p * p)), max_id + 1)::INTEGER AS partitions FROM u"""


@query("partition_plan", _plans_sql())
def _(spark, sf_dir):
    rows = [(m, e, b, t, grid.plan(m, e, b * MIB, t).partitions) for m, e, b, t in PLANS]
    return spark.createDataFrame(rows, "max_id long, edges long, mib long, threads long, partitions int")


# Iteration


@query("lr_init", _EDGES + "SELECT id, (SELECT count(*) FROM e WHERE src = id)::INTEGER AS k, 1.0::DOUBLE AS s FROM v")
def _(spark, sf_dir):
    return initial_state(degrees(clean(GRAPHS["part_supp"](spark, sf_dir))))


@query("lr_contrib", _EDGES + "SELECT id, 1.0::DOUBLE / ((SELECT count(*) FROM e WHERE src = id) + 1) AS c FROM v")
def _(spark, sf_dir):
    return initial_state(degrees(clean(GRAPHS["part_supp"](spark, sf_dir)))).select("id", contribution().alias("c"))


@query("lr_incoming", _walk("part_supp", 1) + " SELECT v.id, round(coalesce((SELECT sum(w) FROM x WHERE dst = v.id AND src <> -1), 0.0), 9) AS x FROM v")
def _(spark, sf_dir):
    edges = clean(GRAPHS["part_supp"](spark, sf_dir))
    state = initial_state(degrees(edges))
    return state.join(incoming(edges, state, False), "id", "left").select("id", F.round(F.coalesce("x", F.lit(0.0)), 9).alias("x"))


@query("lr_step1", _walk("part_supp", 1) + " SELECT id, round(s, 9) AS s FROM t WHERE k = 1 AND id <> -1")
def _(spark, sf_dir):
    g = _prepared(spark, sf_dir)
    return step(g.edges, initial_state(g.vertices), 0.0, g.meta["vertices"], broadcast=False).select("id", F.round("s", 9).alias("s"))


@query("lr_step5", _walk("part_supp", 5) + " SELECT id, round(s, 9) AS s FROM t WHERE k = 5 AND id <> -1")
def _(spark, sf_dir):
    return _fixed(spark, sf_dir, 5, **BY_BROADCAST).scores.select("id", F.round("s", 9).alias("s"))


@query("lr_step5_shuffled", _walk("cust_part", 5) + " SELECT id, round(s, 9) AS s FROM t WHERE k = 5 AND id <> -1")
def _(spark, sf_dir):
    return _fixed(spark, sf_dir, 5, "cust_part", **BY_SHUFFLE).scores.select("id", F.round("s", 9).alias("s"))


@query("lr_step3_exact", _walk("cust_supp", 3) + " SELECT id, round(s, 9) AS s FROM t WHERE k = 3 AND id <> -1")
def _(spark, sf_dir):
    return _fixed(spark, sf_dir, 3, "cust_supp", **EXACT).scores.select("id", F.round("s", 9).alias("s"))


for _name in ("part_supp", "cust_supp", "cust_part"):
    query(f"lr_fixed20_{_name}", _walk(_name, 20) + f" SELECT vertex, round(rank, 9) AS rank FROM ({_ranks_at('20')})")(lambda spark, sf_dir, g=_name: _rounded(_fixed(spark, sf_dir, 20, g).ranks))
    query(f"lr_converged_{_name}", _settled(_name) + f" SELECT vertex, round(rank, 9) AS rank FROM ({_ranks_at('(SELECT it FROM st)')})")(lambda spark, sf_dir, g=_name: _rounded(rank(_prepared(spark, sf_dir, g)).ranks))


@query("lr_scores_and_ground", _settled("part_supp") + " SELECT id, round(s, 6) AS s FROM t WHERE k = (SELECT it FROM st)")
def _(spark, sf_dir):
    out = rank(_prepared(spark, sf_dir))
    ground = spark.createDataFrame([(-1, out.ground)], "id int, s double")
    return out.scores.select("id", "s").unionByName(ground).select("id", F.round("s", 6).alias("s"))


_TRACE = """ SELECT it::INTEGER AS iteration, round(l1, 9) AS l1_per_vertex, round((SELECT s FROM t WHERE k = it AND id = -1), 6) AS ground, round((SELECT sum(s) FROM t WHERE k = it AND id <> -1), 6) AS mass
FROM tr WHERE it <= (SELECT it FROM st)"""


@query("lr_trace", _settled("part_supp") + _TRACE)
def _(spark, sf_dir):
    t = rank(_prepared(spark, sf_dir), **BY_BROADCAST).trace
    return t.select("iteration", F.round("l1_per_vertex", 9).alias("l1_per_vertex"), F.round("ground", 6).alias("ground"), F.round("mass", 6).alias("mass"))


@query("lr_mass_invariant", _settled("part_supp") + " SELECT count(*) AS steps, bool_and(abs(m - (SELECT n FROM n)) <= 1e-9 * (SELECT n FROM n)) AS holds FROM (SELECT sum(s) AS m FROM t WHERE k BETWEEN 1 AND (SELECT it FROM st) GROUP BY k)")
def _(spark, sf_dir):
    g = _prepared(spark, sf_dir)
    n = g.meta["vertices"]
    return rank(g).trace.agg(F.count("*").alias("steps"), F.bool_and(F.abs(F.col("mass") + F.col("ground") - n) <= 1e-9 * n).alias("holds"))


@query("lr_max_iters_not_converged", _walk("supp_part", 10) + f" SELECT vertex, round(rank, 9) AS rank, false AS converged FROM ({_ranks_at('10')})")
def _(spark, sf_dir):
    out = rank(_prepared(spark, sf_dir, "supp_part"), max_iters=10)
    return _rounded(out.ranks).withColumn("converged", F.lit(out.converged))


@query("lr_transpose", _walk("supp_part", 20) + f" SELECT vertex, round(rank, 9) AS rank FROM ({_ranks_at('20')})")
def _(spark, sf_dir):
    edges = GRAPHS["part_supp"](spark, sf_dir, transpose=True)
    return _rounded(rank(prepare(edges, transposed=True), eps=0.0, max_iters=20).ranks)


@query("lr_dangling_only", _settled("cust_part") + f" SELECT vertex, round(rank, 9) AS rank FROM ({_ranks_at('(SELECT it FROM st)')}) WHERE vertex IN (SELECT id FROM d WHERE k = 0)")
def _(spark, sf_dir):
    out = rank(_prepared(spark, sf_dir, "cust_part"))
    return _rounded(out.ranks.join(out.scores.where("k = 0").select(F.col("id").alias("vertex")), "vertex", "left_semi"))


@query("lr_events", _settled("event_next") + f" SELECT vertex, round(rank, 9) AS rank FROM ({_ranks_at('(SELECT it FROM st)')})")
def _(spark, sf_dir):
    return _rounded(rank(_prepared(spark, sf_dir, "event_next")).ranks)


@query("lr_rank_sum", _walk("part_supp", 20) + f" SELECT round(sum(rank), 9) AS total FROM ({_ranks_at('20')})")
def _(spark, sf_dir):
    return _fixed(spark, sf_dir, 20).ranks.agg(F.round(F.sum("rank"), 9).alias("total"))


# Comparison


@query("lr_top100", _walk("part_supp", 20) + f" SELECT vertex, round(rank, 9) AS rank FROM ({_ranks_at('20')}) ORDER BY round(rank, 9) DESC, vertex LIMIT 100")
def _(spark, sf_dir):
    return compare.top_k(_rounded(_fixed(spark, sf_dir, 20).ranks))


_TWO = _walk("part_supp", 20) + f", a AS (SELECT vertex, round(rank, 9) AS rank FROM ({_ranks_at('5')})), b AS (SELECT vertex, round(rank, 9) AS rank FROM ({_ranks_at('20')}))"


def _two(spark, sf_dir):
    g = _prepared(spark, sf_dir)
    return _rounded(rank(g, 0.0, 5).ranks), _rounded(rank(g, 0.0, 20).ranks)


@query("lr_topk_overlap", _TWO + " SELECT count(*) AS overlap FROM (SELECT vertex FROM a ORDER BY rank DESC, vertex LIMIT 100) JOIN (SELECT vertex FROM b ORDER BY rank DESC, vertex LIMIT 100) USING (vertex)")
def _(spark, sf_dir):
    return compare.top_k_overlap(*_two(spark, sf_dir))


_PLACE = "(SELECT vertex, rank() OVER (ORDER BY rank DESC) + (count(*) OVER (PARTITION BY rank) - 1) / 2.0 AS place FROM {})"


@query("lr_spearman", _TWO + f" SELECT round(corr(p.place, q.place), 6) AS spearman FROM {_PLACE.format('a')} p JOIN {_PLACE.format('b')} q USING (vertex)")
def _(spark, sf_dir):
    return compare.spearman(*_two(spark, sf_dir)).select(F.round("spearman", 6).alias("spearman"))


@query("lr_diff_stats", _TWO + ' SELECT count(*) AS "both", 0::BIGINT AS one_only, round(max(abs(a.rank - b.rank)), 8) AS max_abs_diff, round(avg(abs(a.rank - b.rank)), 8) AS mean_abs_diff FROM a JOIN b USING (vertex)')
def _(spark, sf_dir):
    return compare.difference(*_two(spark, sf_dir)).select("both", "one_only", F.round("max_abs_diff", 8).alias("max_abs_diff"), F.round("mean_abs_diff", 8).alias("mean_abs_diff"))


# Text, synthetic graphs, measurements

_LINES = """SELECT l_orderkey, l_linenumber, CASE (l_orderkey + l_linenumber) % 10 WHEN 0 THEN concat(p, ',', s) WHEN 1 THEN concat(p, {tab}, s) WHEN 2 THEN concat(' ', p, ' , ', s, ' ', {cr}) WHEN 3 THEN concat('# ', p) WHEN 4 THEN {cr}
WHEN 5 THEN concat(p, ',', s, ',99') WHEN 6 THEN concat('-', p, ',', s) WHEN 7 THEN p WHEN 8 THEN concat(p, ',two') ELSE concat(p, ',3000000', s) END AS value FROM (SELECT *, {text}(l_partkey) AS p, {text}(l_suppkey) AS s FROM lineitem)"""


def _fault_sql(t: str) -> str:
    return f"CASE WHEN {t} LIKE '-%' THEN 'negative id: ' || {t} WHEN NOT regexp_full_match({t}, '[0-9]+') THEN 'not a number: ''' || {t} || '''' WHEN {t}::HUGEINT > 2147483647 THEN 'id exceeds int32: ' || ({t}::HUGEINT)::VARCHAR END"


_PARSE = f"""WITH l AS ({_LINES.format(tab="chr(9)", cr="chr(13)", text="to_varchar")}), s AS (SELECT *, trim(value, ' ' || chr(13)) AS t FROM l), k AS (SELECT * FROM s WHERE t <> '' AND t NOT LIKE '#%'),
p AS (SELECT *, string_split(t, CASE WHEN contains(t, chr(9)) THEN chr(9) ELSE ',' END) AS c FROM k), q AS (SELECT *, trim(c[1], ' ' || chr(13)) AS a, trim(c[2], ' ' || chr(13)) AS b FROM p),
r AS (SELECT *, CASE WHEN len(c) < 2 THEN 'expected two columns' ELSE coalesce({_fault_sql('a')}, {_fault_sql('b')}) END AS err FROM q)
SELECT l_orderkey, l_linenumber, CASE WHEN err IS NULL THEN a::INTEGER END AS src, CASE WHEN err IS NULL THEN b::INTEGER END AS dst, err FROM r""".replace("to_varchar(l_partkey)", "l_partkey::VARCHAR").replace("to_varchar(l_suppkey)", "l_suppkey::VARCHAR")


@query("parse_edge_text", _PARSE)
def _(spark, sf_dir):
    lines = spark.sql(_LINES.format(tab="'\\t'", cr="'\\r'", text="string").replace("FROM lineitem", "FROM {lineitem}"), lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    return parse_lines(lines).drop("value")


#: Published wall seconds of the preparation by threads.
BENCH = [("synthetic", "prepare", 1, 3.414), ("synthetic", "prepare", 2, 2.625), ("synthetic", "prepare", 4, 1.917), ("synthetic", "prepare", 8, 1.965), ("synthetic", "rank", 1, 1.781), ("synthetic", "rank", 2, 1.223), ("synthetic", "rank", 4, 0.978), ("synthetic", "rank", 8, 0.921)]
_VALUES = ", ".join(f"('{d}', '{t}', {n}, {w}::DOUBLE)" for d, t, n, w in BENCH)


@query("bench_speedup", f"SELECT *, round(first_value(wall_s) OVER w / wall_s, 9) AS speedup, round(first_value(wall_s) OVER w / wall_s / threads, 9) AS efficiency FROM (VALUES {_VALUES}) v(dataset, tool, threads, wall_s) WINDOW w AS (PARTITION BY dataset, tool ORDER BY threads)")
def _(spark, sf_dir):
    rows = spark.createDataFrame(BENCH, "dataset string, tool string, threads int, wall_s double")
    median = rows.groupBy("dataset", "tool", "threads").agg(F.median("wall_s").alias("wall_s"))
    speedup = F.first("wall_s").over(Window.partitionBy("dataset", "tool").orderBy("threads")) / F.col("wall_s")
    return median.withColumn("speedup", F.round(speedup, 9)).withColumn("efficiency", F.round(speedup / F.col("threads"), 9))


@query("synthetic_properties", "SELECT true AS in_range, true AS no_loops, true AS mean_degree, 3::BIGINT AS hubs")
def _(spark, sf_dir):
    """What holds for any seed: 20,000 vertices, mean degree 12, three hubs of 2,000 edges (a vertex has 12 incoming ones besides)."""
    n = 20_000
    edges = generate(spark, n, 12.0, (3, 2_000))
    told = edges.agg(F.bool_and((F.least("src", "dst") >= 0) & (F.greatest("src", "dst") < n)).alias("in_range"), F.bool_and(F.col("src") != F.col("dst")).alias("no_loops"), (F.abs(F.count("*") / n - 12.3) < 0.3).alias("mean_degree"))
    hubs = edges.groupBy("dst").agg(F.count("*").alias("m")).agg(F.count_if(F.col("m") >= 1_900).alias("hubs"))
    return told.crossJoin(hubs)  # a row each


@query("rank_csv_lines", _settled("part_supp") + f" SELECT vertex, true AS named, round(rank, 9) AS rank, true AS digits FROM ({_ranks_at('(SELECT it FROM st)')})")
def _(spark, sf_dir):
    """The lines read back: their vertex, the value to nine digits, and 15 significant digits at most."""
    lines = csv_lines(rank(_prepared(spark, sf_dir)).ranks).withColumn("parts", F.split("line", ","))
    value = F.col("parts")[1]
    digits = F.length(F.regexp_replace(F.regexp_replace(value, "e.*$", ""), "^[0.]*|[.]", "")) <= 15
    return lines.select("vertex", (F.col("parts")[0] == F.col("vertex").cast("string")).alias("named"), F.round(value.cast("double"), 9).alias("rank"), digits.alias("digits"))
