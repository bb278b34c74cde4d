"""Schemas and fixed values of the graph model."""

from __future__ import annotations

EDGE = "src INT, dst INT"
VERTEX = "id INT, out_degree INT, in_degree INT"
RANKS = "vertex INT, rank DOUBLE"
BLOCK_INDEX = "src_interval INT, dst_interval INT, block_pos BIGINT, offset_bytes BIGINT, edge_count BIGINT"
META = "transpose INT, threads_planned INT, max_id INT, partitions INT, vertices BIGINT, edges_raw BIGINT, edges BIGINT, dropped_self_loops BIGINT, dropped_duplicates BIGINT, max_out_degree INT, max_in_degree INT"
TRACE = "iteration INT, l1_per_vertex DOUBLE, ground DOUBLE, mass DOUBLE, seconds DOUBLE"

# Fixed values of the file format, the planner and the iteration.
KIB, MIB, GIB, TIB = 1 << 10, 1 << 20, 1 << 30, 1 << 40
MAX_ID = 2147483647
MAX_LINE = 256 * KIB
EPS = 1e-9
MAX_ITERS = 500
MASS_TOLERANCE = 1e-9
SPARSE_RATIO = 64
BLOCK_ALIGN = 4 * KIB
EDGE_BYTES = 8
COLUMN_BYTES = 20
SCORE_BYTES, DEGREE_BYTES, INDEX_BYTES, LINE_BYTES = 8, 4, 16, 32
CHUNK_VERTICES = 16384


class GraphError(ValueError):
    """Input that can't be ranked."""
