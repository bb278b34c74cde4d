"""Packing token sequences: shortest-pack-first over the histogram of lengths."""

from __future__ import annotations

import json
import zlib
from array import array
from collections import Counter, defaultdict
from functools import cached_property

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnflow.llm.common import Stage, blank_to_empty, slices, table

CAPACITY, END_ID = 1024, 0


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def load_ranks(path: str):
    """The vocabulary of a byte-level BPE file as token bytes with their ids, and its special tokens.

    Such files write each byte as a printable character: printable Latin-1 stands for itself, the others follow from U+0100 on.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    return {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}, special


class Encoder:
    """Ids of whole texts; a second implementation of the same vocabulary does the work at several times the speed.

    Texts that hold a special token's string go to ``tokenizers`` itself, which alone knows such strings.
    """

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        self.path = path
        ranks, self.special = load_ranks(path)
        self.ordinary = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit."""
        if any(s in text for s in self.special):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self.ordinary(text)).tobytes()


_encoders: dict[str, Encoder] = {}


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches):
        encoder = _encoders.get(path) or _encoders.setdefault(path, Encoder(path))
        task, used = TaskContext.get().partitionId(), Counter()
        end = end_id.to_bytes(4, "little")
        for batch in slices(batches):
            owner, starts, lengths, crcs, totals, places = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = encoder.encode(text) + end
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    length = min(capacity, n - start)
                    owner.append(i)
                    starts.append(start)
                    lengths.append(length)
                    crcs.append(zlib.crc32(ids[4 * start : 4 * (start + length)]))
                    totals.append(n)
                    places.append(used[length])
                    used[length] += 1
            cols = [batch.column(0).take(pa.array(owner, pa.int64())), *(pa.array(x, pa.int64()) for x in (starts, lengths, crcs, totals, [task] * len(owner), places))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "place"])

    return run


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns with their counts.

    Lengths are placed longest first, each into the patterns with the most room left; a pattern with more packs than there are pieces is split.
    The work depends on the number of lengths, not of pieces.
    """
    room: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        placed = []
        while left:
            most = max((r for r, packs in room.items() if packs), default=-1)
            if most < length:
                placed.append(((length,), left, capacity - length))
                break
            pattern, packs = room[most].pop()
            if packs > left:
                room[most].append((pattern, packs - left))
            n = min(packs, left)
            left -= n
            # The new pattern may take the same length again once every other pattern has been tried.
            room[most - length].append(((*pattern, length), n))
        for pattern, n, rest in placed:
            fits = 1 + rest // length if length else 1
            whole, over = divmod(n, fits)
            if whole:
                room[capacity - fits * length].append((pattern * fits, whole))
            if over:
                room[capacity - over * length].append((pattern * over, 1))
    return sorted((p for packs in room.values() for p in packs), key=lambda p: (p[0], p[1]), reverse=True)


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """``length, first, past, sequence, offset``: the pieces of a length with ranks first..past-1 go to consecutive sequences at one offset."""
    used: Counter = Counter()
    sequence, out = 0, []
    for pattern, n in patterns:
        offset = 0
        for length in pattern:
            out.append((length, used[length], used[length] + n, sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Each document's ids and the end id are cut every ``capacity``.  Only the histogram of piece lengths (at most ``capacity`` numbers) and
    the patterns made from it are on the driver.  A piece's rank among those of its length is its place within its task, counted while
    tokenizing, plus the earlier tasks' counts: no shuffle ranks rows, and a length that a third of the pieces have is as cheap as any.
    The pieces are written once, so that places and counts are of the same run.

    Null text is empty: one piece that holds the end id.  Repeated rows are documents of their own.  An empty table gives no rows;
    other columns are ignored.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("doc_id"), blank_to_empty(F.col(text_col)).alias("text"))
    longs = ["start", "length", "ids_crc32", "doc_tokens", "task", "place"]
    schema = T.StructType([src.schema["doc_id"], *(T.StructField(n, T.LongType()) for n in longs)])
    pieces = Stage(src.mapInArrow(_pieces(path or tokenizer_path(), capacity, end_id), schema), "pieces")
    counts = pieces.df.groupBy("length", "task").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).select("length", "task", "before")
    plan = spark.createDataFrame(slots(shortest_pack_first(histogram, capacity)), "at long, first long, past long, sequence long, offset long")
    ranked = pieces.df.join(starts, ["length", "task"]).withColumn("rank", F.col("place") + F.col("before"))
    out = ranked.join(F.broadcast(plan), (F.col("length") == F.col("at")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("past")))  # bounded by capacity
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset")


def op4_pack(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
