"""Near-duplicate embeddings by product quantisation: coarse inverted lists, residual codes, exact cosine rerank."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnflow.llm.common import Stage, join_hot, table, tidy
from tarnflow.llm.components import components

COSINE = 0.9
#: The index is fitted on so many distinct vectors, the first by a hash, or on eight a list if that is more, up to MOST_FIT_ROWS; every vector is indexed.
FIT_ROWS, MOST_FIT_ROWS = 20_000, 200_000
LIST_ROWS, MIN_LISTS, LISTS_A_GROUP = 256, 4096, 16
SUBSPACES, CODES = 8, 64
#: A list is ruled out against so many of a query's nearest centroids; more rule out more lists and cost more, results don't change.
WITNESSES = 8
#: Far above the rounding errors of squared distances between unit vectors (those to decoded vectors are in single precision).
SLACK = 1e-5
#: Stored vectors and queries of a task at most, about.
BLOCK, CHUNK = 4_000, 16_000
SEED = 11


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), size=k, replace=False)].copy()
    for _ in range(rounds):
        near = (x @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


@dataclass
class Index:
    """Coarse centroids, the group of lists each belongs to, residual codebooks, and how far apart linked unit vectors are at most.

    Nothing here is estimated: lists and codes are ruled out by the triangle inequality only, so no link is lost however badly the centroids
    and codebooks fit the vectors.
    """

    coarse: np.ndarray
    group: np.ndarray
    books: np.ndarray  # subspace, code, dimension
    reach: float

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "gap"}  # each worker makes its own

    @cached_property
    def gap(self) -> np.ndarray:
        """Distances between the centroids."""
        return self._gaps(np.arange(len(self.coarse)), np.arange(len(self.coarse))).astype(np.float32)

    def _gaps(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        square = (self.coarse * self.coarse).sum(axis=1)
        return np.sqrt(np.maximum(square[a][:, None] + square[b] - 2 * self.coarse[a] @ self.coarse[b].T, 0))

    def far(self, u: np.ndarray) -> np.ndarray:
        """Squared distances to the centroids, without the vector's own square."""
        return (self.coarse * self.coarse).sum(axis=1) - 2 * u @ self.coarse.T

    def home(self, u: np.ndarray, lists: np.ndarray | None = None) -> np.ndarray:
        """The list of the nearest centroid (of those of ``lists``), which stores the vector."""
        lists = np.arange(len(self.coarse)) if lists is None else lists
        near = [self.far(u[at : at + 1024])[:, lists].argmin(axis=1) for at in range(0, len(u), 1024)]
        return lists[np.concatenate([np.zeros(0, dtype=np.int64), *near])]

    def asks(self, u: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """Which of the lists may store a vector that links with each of ``u``.

        What list l stores is no nearer to any other centroid j.  With a vector of u at most ``reach`` off, l's squared distance from u exceeds
        j's by 2 reach |l - j| at most.
        """
        out = np.ones((len(u), len(lists)), dtype=bool)
        for at in range(0, len(u), 1024):
            far = self.far(u[at : at + 1024])
            n = min(WITNESSES, far.shape[1])
            own, rows = far[:, lists], np.arange(len(far))
            for j in np.argpartition(far, n - 1, axis=1)[:, :n].T:
                gap = self.gap[j[:, None], lists] if len(self.coarse) <= MIN_LISTS else self._gaps(j, lists)  # many lists: no table of all pairs
                out[at : at + 1024] &= own - far[rows, j][:, None] <= 2 * self.reach * gap + SLACK
        return out

    def groups(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The group that stores each vector, and which groups it asks."""
        order = np.argsort(self.group, kind="stable")
        held, starts = np.unique(self.group[order], return_index=True)
        out = np.zeros((len(u), self.group.max() + 1), dtype=bool)
        for at in range(0, len(u), 1024):
            out[at : at + 1024, held] = np.logical_or.reduceat(self.asks(u[at : at + 1024], order), starts, axis=1)
        return self.group[self.home(u)], out

    def _split(self, residual: np.ndarray) -> np.ndarray:
        m, _, d = self.books.shape
        return np.pad(residual, ((0, 0), (0, m * d - residual.shape[1]))).reshape(len(residual), m, d)

    def codes(self, residual: np.ndarray) -> np.ndarray:
        parts = self._split(residual)
        return np.stack([(0.5 * (b * b).sum(axis=1) - parts[:, m] @ b.T).argmin(axis=1) for m, b in enumerate(self.books)], axis=1)

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        """Residuals that the codes stand for, padded as by ``_split``."""
        return self.books[np.arange(codes.shape[1]), codes]

    def near(self, queries: np.ndarray, stored: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a list's residuals that may link: by the distance of one side to the other's codes, off by the codes' own error at most.

        All distances to decoded vectors are one matrix product, which is many times faster than summing looked-up tables pair by pair.
        """
        parts = self._split(stored)
        decoded = self.decoded(self.codes(stored))
        error = np.linalg.norm((parts - decoded).reshape(len(stored), -1), axis=1)
        decoded = decoded.reshape(len(stored), -1)
        queries = self._split(queries).reshape(len(queries), -1)
        bound = (self.reach + error) ** 2 + SLACK - (decoded * decoded).sum(axis=1)
        far = queries.astype(np.float32) @ (-2 * decoded).astype(np.float32).T
        return np.nonzero(far + (queries * queries).sum(axis=1, dtype=np.float64).astype(np.float32)[:, None] <= bound.astype(np.float32))


def fit(u: np.ndarray, rows: int, cosine: float = COSINE, seed: int = SEED) -> Index:
    """An index for ``rows`` vectors from a sample of unit vectors."""
    rng = np.random.default_rng(seed)
    # Lists grow with the rows to MIN_LISTS, then with their square root, so that lists and what is in them grow alike.
    wanted = min(rows / LIST_ROWS, max(MIN_LISTS, rows**0.5))
    k = int(min(max(1, len(u) // 8), 1 << max(0, round(np.log2(max(1, wanted))))))
    coarse = _k_means(u, k, rng)
    groups = max(1, k // LISTS_A_GROUP)
    tops = _k_means(coarse, groups, rng)
    group = (coarse @ tops.T - 0.5 * (tops * tops).sum(axis=1)).argmax(axis=1)
    index = Index(coarse, group, np.zeros((SUBSPACES, 1, -(-u.shape[1] // SUBSPACES))), float(np.sqrt(max(0.0, 2 - 2 * cosine))))
    parts = index._split(u - coarse[index.home(u)])
    codes = min(CODES, len(u))
    index.books = np.stack([_k_means(parts[:, m], codes, rng) for m in range(SUBSPACES)])
    return index


def unit(vectors: np.ndarray) -> np.ndarray:
    """Of length one, in double precision; scaled first, so that no square overflows or vanishes."""
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1)[:, None]


def _read(dims: int, wide: bool):
    """Rows with a name for the vector's direction-bearing content, and the vector as bytes; null where it links with nothing."""
    dtype = np.float64 if wide else np.float32

    def run(batches):
        for batch in batches:
            ids, col = batch.column("vec_id"), batch.column("embedding")
            size = np.nan_to_num(pa.compute.fill_null(pa.compute.list_value_length(col), -1).to_numpy(zero_copy_only=False)).astype(np.int64)
            flat = col.flatten().to_numpy(zero_copy_only=False).astype(dtype)
            ends = np.cumsum(np.maximum(size, 0))
            full = np.flatnonzero(size == dims)
            x = flat[(ends[full] - dims)[:, None] + np.arange(dims)] if len(full) else np.zeros((0, dims), dtype=dtype)
            good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            keys, vectors = [None] * len(size), [None] * len(size)
            for i, v in zip(full[good], x[good] + dtype(0)):  # minus zero is zero
                vectors[i] = v.tobytes()
                keys[i] = int(np.uint64(xxhash.xxh3_64_intdigest(vectors[i])).astype(np.int64))
            yield pa.RecordBatch.from_arrays([ids, pa.array(keys, pa.int64()), pa.array(vectors, pa.binary())], ["vec_id", "key", "vector"])

    return run


def _matrix(blobs: list[bytes], dims: int, wide: bool) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype=np.float64 if wide else np.float32).reshape(len(blobs), dims)


def _load(index, dims: int, wide: bool):
    """Stored vectors and queries that each group of lists will have."""

    def run(batches):
        ix = index.value
        stored, asked = np.zeros(ix.group.max() + 1, dtype=np.int64), np.zeros(ix.group.max() + 1, dtype=np.int64)
        for batch in batches:
            home, asks = ix.groups(unit(_matrix(batch.column("vector").to_pylist(), dims, wide)))
            stored += np.bincount(home, minlength=len(stored))
            asked += asks.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(stored))), pa.array(stored), pa.array(asked)], ["g", "stored", "asked"])

    return run


def _deal(index, load: dict[int, tuple[int, int]], dims: int, wide: bool):
    """Vectors to the cells of their groups: a cell is a block of stored vectors against a chunk of queries."""

    def run(batches):
        ix = index.value
        for batch in batches:
            keys, weights, vectors = (batch.column(c).to_pylist() for c in ("key", "weight", "vector"))
            homes, asks = ix.groups(unit(_matrix(vectors, dims, wide)))
            out: list[tuple] = []
            for key, weight, vector, home, asked_groups in zip(keys, weights, vectors, homes.tolist(), asks):
                spread = key & 0xFFFFFFFF
                for g in np.flatnonzero(asked_groups).tolist():
                    stored, asked = load[g]
                    out.extend((g, b, spread % asked, False, key, weight, vector) for b in range(stored))
                stored, asked = load[home]
                out.extend((home, (spread >> 7) % stored, c, True, key, weight, vector) for c in range(asked))
                if len(out) >= 20_000:
                    yield _dealt(out)
                    out = []
            yield _dealt(out)

    return run


CELL = "g int, block int, chunk int, stored boolean, key long, weight long, vector binary"


def _dealt(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * 7
    types = (pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], [x.split()[0] for x in CELL.split(", ")])


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes reaches over the links."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _match(index, dims: int, wide: bool, cosine: float):
    """In a cell: links found, counted for the query, and a spanning set of them.

    A query finds all that it links with in the lists that it asks, so either end of a link counts it where it is the query.
    """

    @tidy
    def run(t: pa.Table) -> pa.Table:
        ix = index.value
        role = t.column("stored").to_numpy(zero_copy_only=False).astype(bool)
        key, weight = t.column("key").to_numpy(), t.column("weight").to_numpy()
        u = unit(_matrix(t.column("vector").to_pylist(), dims, wide))
        g = t.column("g")[0].as_py()
        s, q = np.flatnonzero(role), np.flatnonzero(~role)
        names, place = np.unique(key, return_inverse=True)
        links = np.zeros(len(names), dtype=np.int64)
        lists = np.flatnonzero(ix.group == g)
        home, asks = ix.home(u[s], lists), ix.asks(u[q], lists)
        ends_a, ends_b = [], []
        for at_list, l in enumerate(lists):
            held, askers = s[home == l], q[asks[:, at_list]]
            if not len(held) or not len(askers):
                continue
            residual = u[held] - ix.coarse[l]
            for at in range(0, len(askers), 1024):
                part = askers[at : at + 1024]
                i, j = ix.near(u[part] - ix.coarse[l], residual)
                a, b = part[i], held[j]
                other = key[a] != key[b]
                a, b = a[other], b[other]
                for k in range(0, len(a), 1 << 18):
                    x, y = a[k : k + (1 << 18)], b[k : k + (1 << 18)]
                    near = np.einsum("ij,ij->i", u[x], u[y]) >= cosine
                    x, y = x[near], y[near]
                    np.add.at(links, place[x], weight[y])
                    ends_a.append(place[x])
                    ends_b.append(place[y])
        a, b = (np.concatenate([np.zeros(0, dtype=np.int64), *z]) for z in (ends_a, ends_b))
        root = _roots(len(names), a, b)
        told = np.flatnonzero((links > 0) | (root != np.arange(len(names))))
        return pa.table({"key": pa.array(names[told]), "links": pa.array(links[told]), "root": pa.array(names[root[told]])})

    return run


def embedding_components(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per input row: ``vec_id, n_links, component_id, kept``.

    Identical vectors are one vector with a weight.  The index (coarse lists, residual codebooks) is fitted on a bounded sample; every vector is
    stored in its list and asks all lists that may store one it links with, so links are complete.  Lists are dealt in groups, hot groups in blocks and chunks of bounded size.
    Candidates by their codes are reranked by their exact cosine in double precision; links are counted in the cells, never emitted as
    pairs, and each cell hands on a spanning set of its links for the components.

    Vectors that are null, zero, of another length than the most common one, or that hold null or non-finite components link with
    nothing and are their own component.  Rows that repeat a vector are linked.  A null id never names a component that has another.  An empty
    table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    src = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"))
    wide = "float" not in src.schema["embedding"].dataType.simpleString()
    common = src.where(F.size("embedding") > 0).groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dims = common["d"] if common else 1
    schema = T.StructType([src.schema["vec_id"], T.StructField("key", T.LongType()), T.StructField("vector", T.BinaryType())])
    rows = Stage(src.mapInArrow(_read(dims, wide), schema), "vectors")
    distinct = Stage(rows.df.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("weight"), F.min("vector").alias("vector")), "distinct-vectors")
    n = distinct.df.count()
    named = rows.df.select("vec_id", "key")
    if n:
        most = max(fit_rows, min(MOST_FIT_ROWS, 8 * int(n**0.5)))
        chosen = distinct.df
        if n > most:  # a threshold on the hash leaves about that many before they are sorted
            chosen = chosen.where(F.xxhash64("key") < F.lit(int(-(1 << 63) + (1 << 64) * (most + 4 * most**0.5 + 16) / n)))
        sample = chosen.orderBy(F.xxhash64("key")).limit(most).select("vector").collect()  # bounded: fit_rows or MOST_FIT_ROWS
        ix = fit(unit(_matrix([bytes(r["vector"]) for r in sample], dims, wide)), n, cosine)
        index = spark.sparkContext.broadcast(ix)  # bounded: MOST_FIT_ROWS / 8 centroids and the codebooks
        loads = distinct.df.mapInArrow(_load(index, dims, wide), "g long, stored long, asked long").groupBy("g").agg(F.sum("stored").alias("s"), F.sum("asked").alias("a")).collect()  # a row a group of lists
        load = {r["g"]: (max(1, -(-r["s"] // BLOCK)), max(1, -(-r["a"] // CHUNK))) for r in loads}
        cells = distinct.df.mapInArrow(_deal(index, load, dims, wide), CELL).groupBy("g", "block", "chunk")
        found = Stage(cells.applyInArrow(_match(index, dims, wide, cosine), "key long, links long, root long"), "vector-links")
        counts = found.df.groupBy("key").agg(F.sum("links").alias("links"))
        label = components(found.df.where("key <> root"), "key", "root").df
    else:
        counts = spark.createDataFrame([], "key long, links long")
        label = spark.createDataFrame([], "node long, label long")
    classes = distinct.df.select("key", "weight").join(counts, "key", "left").join(label.withColumnRenamed("node", "key"), "key", "left")
    classes = Stage(classes.select("key", "weight", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("label", "key").alias("label")), "vector-classes").df
    # Vectors without a key keep out of the joins: they would all go to one task.
    known = join_hot(named.where("key IS NOT NULL"), classes, "key", "vec_id", n="weight")
    whole = Stage(known.select("vec_id", "n_links", "label"), "vector-rows").df
    least = Stage(whole.groupBy("label").agg(F.min("vec_id").alias("least"), F.count("*").alias("n")), "least-ids").df
    linked = join_hot(whole, least, "label", "vec_id").select("vec_id", "n_links", F.col("least").alias("component_id"))
    alone = named.where("key IS NULL").select("vec_id", F.lit(0).alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op6_product_quantisation(spark, sf_dir: str) -> DataFrame:
    return embedding_components(table(spark, sf_dir, "embeddings"))


ORACLE = r"""
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
l AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM e x JOIN e y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.v, y.v) >= 0.9),
r(vec_id, r) AS (SELECT vec_id, vec_id FROM e UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.r = l.a),
c AS (SELECT vec_id, min(r) AS component_id FROM r GROUP BY vec_id)
SELECT vec_id, (SELECT count(*) FROM l WHERE a = c.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c
"""
