"""Jaccard self-join on word shingles by vertical partitioning: partial overlaps by fragment of the global n-gram order, summed per pair."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnflow.llm.common import Stage, blank_to_empty, join_hot, slices, table, tidy
from tarnflow.llm.components import components
from tarnflow.llm.shingles import mix, set_key, shingle_sets

WORDS = 5
#: Percent of the union that two sets must share.
PERCENT = 80
#: Shingles that a task holds at once, about.
TASK_SHINGLES = 2_000_000
FLUSH = 500_000
TASK_PAIRS = 2_000_000
#: Pivots are quantiles of so many n-grams, about.
PIVOT_SAMPLE = 50_000
#: Parts that the pairs of one n-gram are dealt to if it is hot.
CROSS_PARTS = 16
#: An n-gram of so many sets that may still cross is hot.
HOT_GRAM = 2_000
MIN_FRAGMENTS = 8
#: Bits that tell how far two sets differ at least.
BITS = 1024


def _need(n):
    """The least overlap that a set of n shingles can link with."""
    return (PERCENT * n + 99) // 100


def _doc_sets(words: int):
    def run(batches):
        for batch in slices(batches):
            ns, keys = [], []
            for s in shingle_sets(batch.column("text").to_pylist(), words):
                ns.append(len(s))
                keys.append(set_key(s))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ns, pa.int64()), pa.array(keys, pa.int64())], ["doc_id", "n", "key"])

    return run


def _blob(keys: np.ndarray, ns: np.ndarray, counts: np.ndarray, hashes: np.ndarray, dfs: np.ndarray | None = None) -> bytes:
    """Segments of sets: names, set sizes, numbers of n-grams here, then the n-grams, with their frequencies if known."""
    head = np.array([len(keys), len(hashes)], dtype=np.int64)
    parts = [head, keys.astype(np.int64), ns.astype(np.int32), counts.astype(np.int32), hashes.astype(np.uint64)]
    return b"".join(x.tobytes() for x in (parts if dfs is None else [*parts, dfs.astype(np.int32)]))


def _unblob(blobs: list[bytes], dfs: bool):
    out: list[list[np.ndarray]] = [[], [], [], [], []]
    for b in blobs:
        m, k = np.frombuffer(b, dtype=np.int64, count=2)
        at = 16
        for i, (dtype, n) in enumerate(((np.int64, m), (np.int32, m), (np.int32, m), (np.uint64, k), (np.int32, k if dfs else 0))):
            out[i].append(np.frombuffer(b, dtype=dtype, count=n, offset=at))
            at += n * np.dtype(dtype).itemsize
    return [np.concatenate(x) for x in out]


def _scatter(words: int, buckets: int):
    """Each set cut by range of the hash; a task hands on one blob a bucket and flush."""
    width = (1 << 64) // buckets + 1

    def flush(sets: dict[int, np.ndarray]):
        keys, sizes = np.array(list(sets), dtype=np.int64), np.array([len(s) for s in sets.values()])
        hashes, owner = np.concatenate(list(sets.values())), np.repeat(np.arange(len(keys), dtype=np.int32), sizes)
        bucket = (hashes // np.uint64(width)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        hashes, owner, bucket = hashes[order], owner[order], bucket[order]
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        rows = []
        for a, b in zip([0, *cuts], [*cuts, len(bucket)]):
            own, counts = np.unique(owner[a:b], return_counts=True)
            rows.append((int(bucket[a]), _blob(keys[own], sizes[own], counts, hashes[a:b])))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "blob"])

    def run(batches):
        sets: dict[int, np.ndarray] = {}
        held = 0
        for batch in slices(batches):
            for s in shingle_sets(batch.column("text").to_pylist(), words):
                if len(s) and (key := set_key(s)) not in sets:
                    sets[key] = s
                    held += len(s)
                    if held >= FLUSH:
                        yield flush(sets)
                        sets, held = {}, 0
        if sets:
            yield flush(sets)

    return run


def _share(groups: int):
    """In a bucket: the document frequency of each n-gram, then what is shared, by group of sets."""

    @tidy
    def run(t: pa.Table) -> pa.Table:
        keys, ns, counts, hashes, _ = _unblob(t.column("blob").to_pylist(), False)
        _, first = np.unique(keys, return_index=True)  # equal sets from several tasks count once
        alone = np.zeros(len(keys), dtype=bool)
        alone[first] = True
        hashes = hashes[np.repeat(alone, counts)]
        keys, ns, counts = keys[alone], ns[alone], counts[alone]
        order = np.argsort(hashes)
        ordered = hashes[order]
        starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        del ordered
        times = np.diff(np.append(starts, len(hashes))).astype(np.int32)
        df = np.empty(len(hashes), dtype=np.int32)
        df[order] = np.repeat(times, times)
        del order
        shared = df > 1
        owner = np.repeat(np.arange(len(keys), dtype=np.int32), counts)[shared]
        hashes, df = hashes[shared], df[shared]
        group = (keys.view(np.uint64) % np.uint64(groups)).astype(np.int32)[owner]
        order = np.argsort(group, kind="stable")
        owner, group, h, d = owner[order], group[order], hashes[order], df[order]
        del order, hashes, df
        rows = []
        cuts = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(group)]):
            if b > a:
                own, n = np.unique(owner[a:b], return_counts=True)
                rows.append((int(group[a]), _blob(keys[own], ns[own], n, h[a:b], d[a:b])))
        return pa.table({"part": pa.array([r[0] for r in rows], pa.int64()), "blob": pa.array([r[1] for r in rows], pa.binary())})

    return run


SURVIVOR = "key long, n int, shared int, common double, prefix array<long>, grams binary, freq binary, bits array<long>"
#: A posting: at this n-gram the set can still link with sets of at most ``reach`` n-grams, as all later ones of it are not enough for larger ones.
REACH = f"(100 + {PERCENT}) * (shared - place) DIV {PERCENT} - n"


def _parity(hashes: np.ndarray) -> np.ndarray:
    """For each value of the hash's last bits whether an odd number of n-grams has it, as BITS bits."""
    odd = np.bincount((hashes & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


@tidy
def _survive(t: pa.Table) -> pa.Table:
    """Sets that share enough n-grams with others to link at all, those in global order (frequency, hash), and the prefix of that order.

    ``common`` is the mean frequency of the set's n-grams: the text that others are copies of has more than they.
    """
    keys, ns, counts, hashes, dfs = _unblob(t.column("blob").to_pylist(), True)
    posting = np.repeat(keys, counts)
    order = np.lexsort((hashes, dfs, posting))
    posting, hashes, dfs, n = posting[order], hashes[order], dfs[order], np.repeat(ns, counts)[order]
    starts = np.flatnonzero(np.concatenate([[True], posting[1:] != posting[:-1]])) if len(posting) else np.zeros(0, dtype=np.int64)
    ends = np.append(starts[1:], len(posting))
    rows = []
    for a, b in zip(starts, ends):
        spare = int(b - a - _need(int(n[a])))
        if spare >= 0:
            common = float(dfs[a:b].sum() + n[a] - (b - a)) / float(n[a])
            rows.append((int(posting[a]), int(n[a]), int(b - a), common, hashes[a : a + spare + 1].view(np.int64), hashes[a:b].tobytes(), dfs[a:b].astype(np.int32).tobytes(), _parity(hashes[a:b])))
    cols = list(zip(*rows)) or [[]] * 8
    types = (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.list_(pa.int64()))
    return pa.table([pa.array(list(c), k) for c, k in zip(cols, types)], names=["key", "n", "shared", "common", "prefix", "grams", "freq", "bits"])


def _place(hashes: np.ndarray, freq: np.ndarray) -> np.ndarray:
    """Where n-grams stand in the global order, as one number that grows with frequency, then hash."""
    return np.minimum(freq, 65535).astype(np.uint64) << np.uint64(48) | hashes >> np.uint64(16)


def _places(every: int):
    """The places of one n-gram of a set in ``every``, chosen by a hash of both."""

    def run(batches):
        for batch in slices(batches):
            out = [np.zeros(0, dtype=np.int64)]
            for key, grams, freq in zip(*(batch.column(c).to_pylist() for c in ("key", "grams", "freq"))):
                h = np.frombuffer(grams, dtype=np.uint64)
                some = mix(h ^ np.uint64(key & 0xFFFFFFFFFFFFFFFF)) % np.uint64(every) == 0
                out.append(_place(h[some], np.frombuffer(freq, dtype=np.int32)[some]).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out))], ["place"])

    return run


def _fragments_of(grams: bytes, freq: bytes, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A set's n-grams by fragment, and the fragment of each."""
    h = np.frombuffer(grams, dtype=np.uint64)
    fragment = np.searchsorted(pivots, _place(h, np.frombuffer(freq, dtype=np.int32)), side="right")
    order = np.argsort(fragment, kind="stable")
    return h[order], fragment[order]


def _held_fragments(pivots: np.ndarray):
    """The fragments that hold n-grams of each set."""

    def run(batches):
        for batch in slices(batches):
            held = [np.unique(_fragments_of(g, f, pivots)[1]).astype(np.int32) for g, f in zip(batch.column("grams").to_pylist(), batch.column("freq").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(held, pa.list_(pa.int32()))], ["key", "fragments"])

    return run


def _segments(pivots: np.ndarray):
    """A set's n-grams cut at the pivots, a row a fragment."""

    def run(batches):
        for batch in slices(batches):
            out: list[tuple] = []
            for key, slot, grams, freq in zip(*(batch.column(c).to_pylist() for c in ("key", "slot", "grams", "freq"))):
                h, f = _fragments_of(grams, freq, pivots)
                cuts = np.flatnonzero(np.diff(f)) + 1
                out.extend((int(f[a]), slot, key, np.sort(h[a:b]).tobytes()) for a, b in zip([0, *cuts], [*cuts, len(f)]))
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.binary()))], ["fragment", "slot", "key", "grams"])

    return run


@tidy
def _partial(left: pa.Table, right: pa.Table) -> pa.Table:
    """Overlaps within one fragment of the pairs of one slot."""
    keys = left.column("key").to_numpy()
    order = np.argsort(keys)
    keys = keys[order]
    blobs = left.column("grams").to_pylist()
    sizes = np.array([len(blobs[i]) // 8 for i in order], dtype=np.int64)
    grams = np.frombuffer(b"".join(blobs[i] for i in order), dtype=np.uint64)
    names, rank = np.unique(grams, return_inverse=True)
    ends = np.cumsum(sizes)
    full = np.repeat(np.arange(len(keys), dtype=np.int64), sizes) * len(names) + rank  # sorted: by set, then n-gram
    a, b = right.column("a").to_numpy(), right.column("b").to_numpy()
    if len(keys):
        ia, ib = np.minimum(np.searchsorted(keys, a), len(keys) - 1), np.minimum(np.searchsorted(keys, b), len(keys) - 1)
        both = (keys[ia] == a) & (keys[ib] == b)
    else:
        both = np.zeros(len(a), dtype=bool)
    a, b = a[both], b[both]
    if not len(a):
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "partial": pa.array([], pa.int64())})
    ia, ib = ia[both], ib[both]
    swap = sizes[ia] > sizes[ib]
    ia, ib = np.where(swap, ib, ia), np.where(swap, ia, ib)
    out = np.zeros(len(a), dtype=np.int64)
    work = np.cumsum(sizes[ia])
    at = 0
    while at < len(a):
        end = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + FLUSH)))
        n = sizes[ia[at:end]]
        pair = np.repeat(np.arange(end - at), n)
        inner = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
        sought = ib[at:end][pair] * len(names) + rank[(ends[ia[at:end]] - n)[pair] + inner]
        place = np.minimum(np.searchsorted(full, sought), len(full) - 1)
        out[at:end] = np.bincount(pair[full[place] == sought], minlength=end - at)
        at = end
    hit = out > 0
    return pa.table({"a": pa.array(a[hit]), "b": pa.array(b[hit]), "partial": pa.array(out[hit])})


def _verified(survivors: DataFrame, held: DataFrame, pairs: DataFrame, pivots: np.ndarray) -> DataFrame:
    """The pairs ``a, b`` that link.  Partial overlaps are counted apart in every slot of pairs and every fragment that both sets have n-grams in,
    and summed per pair."""
    slots = max(1, -(-pairs.count() // TASK_PAIRS))
    asked = pairs.withColumn("slot", F.pmod(F.xxhash64("a"), F.lit(slots)).cast("int"))
    sides = asked.select(F.col("a").alias("key"), "slot").union(asked.select("b", "slot")).distinct()
    segments = survivors.select("key", "grams", "freq").join(sides, "key").select("key", "slot", "grams", "freq").mapInArrow(_segments(pivots), "fragment int, slot int, key long, grams binary")
    # A centre is one end of the pairs of a large group of copies, so its pairs are dealt out.
    many = pairs.groupBy(F.col("b").alias("key")).agg(F.count("*").alias("n"))
    of_b = join_hot(asked.withColumnRenamed("b", "key"), held.join(many, "key").withColumnRenamed("fragments", "fb"), "key", "a").drop("n").withColumnRenamed("key", "b")
    many = pairs.groupBy(F.col("a").alias("key")).agg(F.count("*").alias("n"))
    both = join_hot(of_b.withColumnRenamed("a", "key"), held.join(many, "key").withColumnRenamed("fragments", "fa"), "key", "b").drop("n").withColumnRenamed("key", "a")
    spread = both.select(F.explode(F.array_intersect("fa", "fb")).alias("fragment"), "slot", "a", "b")
    partial = segments.groupBy("fragment", "slot").cogroup(spread.groupBy("fragment", "slot")).applyInArrow(_partial, "a long, b long, partial long")
    overlap = partial.groupBy("a", "b").agg(F.sum("partial").alias("both"))
    return pairs.join(overlap, ["a", "b"]).where(100 * F.col("both") >= PERCENT * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def _stars(by: str, *ends):
    """Of each n-gram's sets the largest by ``by`` as a centre; each set is held against the centre of its most (F.max) or least (F.min) common n-gram, or both."""

    def step(posts: DataFrame) -> DataFrame:
        head = F.max(F.struct(F.col(by).alias("weight"), "n", "key", "label"))
        heads = posts.groupBy("gram").agg(head.alias("head"), F.count("*").alias("m"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("gram", "head", "m")
        small, large = F.least("n", "head.n"), F.greatest("n", "head.n")
        able = posts.join(heads, "gram").where((F.col("head.label") != F.col("label")) & (100 * small >= PERCENT * large))
        choice = F.struct("m", "head")
        two = able.groupBy("key", "n").agg(F.array_distinct(F.array(*(end(choice)["head"] for end in ends))).alias("heads")).select("key", "n", F.explode("heads").alias("head"))
        return _pairs(F.struct("n", "key"), F.struct("head.n", "head.key"), two)

    return step


def _pairs(x, y, rows: DataFrame) -> DataFrame:
    """Pairs in one order, the smaller set first."""
    both = rows.select(F.least(x, y).alias("p"), F.greatest(x, y).alias("q"))
    return both.select(F.col("p.key").alias("a"), F.col("q.key").alias("b"), F.col("p.n").alias("na"), F.col("q.n").alias("nb")).distinct()


def _crossed(survivors: DataFrame):
    """All pairs from different components that could link by their place at a common prefix n-gram and by their bits.

    At the first n-gram common to two sets that link, what is left of either (it included) is at least their overlap, so neither is
    larger than the other's reach there.  Sets edited so much that they reach no set in the n-gram leave before the join.
    Each bit in which two sets differ stands for an n-gram that only one of them has, so twice their overlap is at most what
    they share with any others less those bits.
    """

    def step(posts: DataFrame) -> DataFrame:
        for _ in range(2):
            least = posts.groupBy("gram").agg(F.min("n").alias("least"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("gram", "least")
            posts = posts.join(least, "gram").where("reach >= least").drop("least")
        posts = Stage(posts.join(survivors.select("key", "shared", "bits"), "key"), "posts-crossing").df
        sizes = posts.groupBy("gram").agg(F.count("*").alias("n"))
        hot = [r[0] for r in sizes.where(F.col("n") >= HOT_GRAM).select("gram").collect()] if posts.count() >= HOT_GRAM else []  # postings / HOT_GRAM at most
        is_hot = F.col("gram").isin(hot) if hot else F.lit(False)
        dealt = F.when(is_hot, F.pmod(F.xxhash64("key"), F.lit(CROSS_PARTS)).cast("int")).otherwise(0)
        parts = F.when(is_hot, F.sequence(F.lit(0), F.lit(CROSS_PARTS - 1))).otherwise(F.array(F.lit(0)))
        x, y = posts.withColumn("part", dealt).alias("x"), posts.withColumn("part", F.explode(parts)).alias("y")
        apart = (F.col("x.gram") == F.col("y.gram")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.label") != F.col("y.label")) & (F.struct("x.n", "x.key") < F.struct("y.n", "y.key"))
        within = (F.col("x.n") <= F.col("y.reach")) & (F.col("y.n") <= F.col("x.reach"))
        differ = sum((F.bit_count(F.col("x.bits")[i].bitwiseXOR(F.col("y.bits")[i])) for i in range(BITS // 64)), F.lit(0))
        enough = (100 + PERCENT) * (F.col("x.shared") + F.col("y.shared") - differ) >= 2 * PERCENT * (F.col("x.n") + F.col("y.n"))
        return x.join(y, apart & within & enough).select(F.col("x.key").alias("a"), F.col("y.key").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb")).distinct()

    return step


def _all(stages: list[Stage]) -> DataFrame:
    out = stages[0].df
    for s in stages[1:]:
        out = out.union(s.df)
    return out


def shingle_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, task_shingles: int = TASK_SHINGLES) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id``.

    Equal sets are one set throughout (named by a hash of the whole set), so copies are never paired.

    1. Sets are cut by range of the n-gram hash.  Each range counts its n-grams' document frequencies; n-grams of one set are dropped.
    2. A set that shares less than 80% of its n-grams with any others can't link and goes.  The rest stand in global order: frequency, then hash.
    3. Prefix filter: sets that link share an n-gram among the first that could be spared.  Each set is first held against the set with
       the commonest n-grams (the text that near copies come from) of its most common such n-gram; what is still apart, of its least common one;
       then against the largest of both: a few pairs a set, and one where the first links.
    4. Overlaps are counted by fragment of the global order (cut at quantiles), of those in which both sets have n-grams, and summed per pair; links
       are joined to components.
    5. Of the n-grams whose sets are still in different components all pairs across components that could link by their places in both
       sets, and by how far their bits differ, are held against each other; pairs within a component can't change the result.  So a large group of near copies needs a few pairs a member.

    Null and empty texts and texts without words have no shingles, link with nothing and are their own component; fewer than ``words`` words are one
    shingle.  Repeated rows are equal sets.  A null id never names a component that has another.  An empty table gives no rows;
    other columns are ignored.  N-grams and sets are told apart by 64-bit hashes.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), blank_to_empty(F.col(text_col)).cast("binary").alias("text"))
    spark = docs.sparkSession
    schema = T.StructType([src.schema["doc_id"], T.StructField("n", T.LongType()), T.StructField("key", T.LongType())])
    named = Stage(src.mapInArrow(_doc_sets(words), schema), "shingle-sets")
    total = named.df.agg(F.sum("n")).first()[0] or 0
    buckets = max(MIN_FRAGMENTS, -(-total // task_shingles))
    scattered = src.select("text").mapInArrow(_scatter(words, buckets), "bucket long, blob binary")
    shared = Stage(scattered.groupBy("bucket").applyInArrow(_share(buckets), "part long, blob binary"), "shingles-shared")
    kept = Stage(shared.df.groupBy("part").applyInArrow(_survive, SURVIVOR), "shingles-kept")
    shared.drop()
    survivors = kept.df

    left = survivors.agg(F.sum("shared"), F.count("*")).first()
    fragments = max(MIN_FRAGMENTS, -(-(left[0] or 0) // task_shingles))
    sample = survivors.mapInArrow(_places(max(1, (left[0] or 0) // PIVOT_SAMPLE)), "place long").collect()  # PIVOT_SAMPLE numbers, about: pivots only balance the fragments
    places = np.array([r["place"] for r in sample], dtype=np.int64).view(np.uint64)
    pivots = np.quantile(places, np.arange(1, fragments) / fragments, method="nearest") if len(places) else np.arange(1, fragments, dtype=np.uint64)
    held = Stage(survivors.select("key", "grams", "freq").mapInArrow(_held_fragments(pivots), "key long, fragments array<int>"), "fragments-held").df

    posted = survivors.select(F.posexplode("prefix").alias("place", "gram"), "key", "n", "shared", "common").withColumn("reach", F.expr(REACH))
    posts = Stage(posted.select("gram", "key", "n", "common", "reach", F.col("key").alias("label")), "posts")
    tried: list[Stage] = []
    links: list[Stage] = []
    cross = _crossed(survivors)
    for step in (_stars("common", F.max), _stars("common", F.min), _stars("n", F.max, F.min), cross):
        asked = step(posts.df)
        for earlier in tried:
            asked = asked.join(earlier.df, ["a", "b"], "left_anti")
        tried.append(Stage(asked, "pairs"))
        if not tried[-1].df.limit(1).count():
            continue
        found = Stage(_verified(survivors, held, tried[-1].df, pivots), "links")
        links.append(found)
        label = components(_all(links))
        # Only n-grams whose sets are in different components can still tell anything.
        named_posts = posts.df.drop("label").join(label.df.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
        mixed = named_posts.groupBy("gram").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("gram")
        if step is not cross:
            open_posts = Stage(named_posts.join(mixed, "gram", "left_semi"), "posts")
            posts.drop()
            posts = open_posts
    label_df = label.df if links else spark.createDataFrame([], "node long, label long")
    copies = named.df.where("n > 0").groupBy("key").agg(F.count("*").alias("m"))
    told = label_df.withColumnRenamed("node", "key").join(copies, "key")
    classes = join_hot(named.df, told, "key", "doc_id", "left", n="m").withColumn("label", F.coalesce("label", "key"))
    rows = Stage(classes.select("doc_id", "n", "label"), "labelled")
    smallest = Stage(rows.df.where("n > 0").groupBy("label").agg(F.min("doc_id").alias("least"), F.count("*").alias("m")), "least-ids").df
    out = join_hot(rows.df, smallest, "label", "doc_id", "left", n="m")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def op7_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return shingle_components(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS MATERIALIZED (SELECT DISTINCT doc_id, hash(CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i : i + 4], ' ') END) AS h
  FROM (SELECT doc_id, ws, unnest(generate_series(1, CASE WHEN len(ws) < 5 THEN 1 ELSE len(ws) - 4 END)) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
s AS MATERIALIZED (SELECT * FROM g WHERE h IN (SELECT h FROM g GROUP BY h HAVING count(*) > 1)),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
r(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.r = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.r) AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY d.doc_id, n.n
"""
