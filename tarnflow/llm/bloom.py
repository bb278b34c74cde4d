"""Bloom filters of 64-bit hashes, built slice by slice and broadcast, of a size that is bounded."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bits a key of a filter, and the most bits of a filter (2**30: 128 MB).  Beyond 64 million keys the fixed filter lets
#: more through to what follows it; results stay the same.
BITS_A_KEY, MAX_BITS = 16, 1 << 30
SLICES = 64


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Two filter positions a hash, side by side."""
    mask = np.uint64(bits - 1)
    return np.stack([hashes & mask, (hashes >> np.uint64(32)) & mask])


def positions_of(hashes: np.ndarray, bits: int) -> pa.RecordBatch:
    """Filter positions of hashes by slice, sorted; those of a hash that is there more than once come twice."""
    width = bits // SLICES
    once, n = np.unique(hashes, return_counts=True)
    p = np.sort(np.concatenate([positions(once, bits).ravel(), positions(once[n > 1], bits).ravel()]))
    cuts = np.searchsorted(p, np.arange(SLICES + 1, dtype=np.uint64) * np.uint64(width))
    rows = [(s, (p[a:b] - np.uint64(s * width)).astype(np.uint32).tobytes()) for s, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
    return pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["slice", "seen"])


def seen_ids(bits: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield positions_of(batch.column(0).to_numpy().view(np.uint64), bits)

    return run


def _merge(bits: int, twice: bool):
    """The filter of what was seen, or seen twice, slice by slice; a slice holds one flag a position however much arrives."""
    width = bits // SLICES

    def run(batches):
        first: dict[int, np.ndarray] = {}
        second: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, seen in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                p = np.frombuffer(seen, dtype=np.uint32)
                once = first.setdefault(s, np.zeros(width, dtype=bool))
                again = second.setdefault(s, np.zeros(width, dtype=bool))
                again[p[once[p]]] = True
                once[p] = True
                again[p[1:][p[1:] == p[:-1]]] = True  # positions come sorted
        out = second if twice else first
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array([np.packbits(x).tobytes() for x in out.values()], pa.binary())], ["slice", "bits"])

    return run


def build(seen: DataFrame, bits: int, twice: bool):
    """A broadcast filter of bits / 8 bytes."""
    merged = seen.repartition(SLICES, "slice").mapInArrow(_merge(bits, twice), "slice int, bits binary").collect()
    parts = {r["slice"]: bytes(r["bits"]) for r in merged}
    return seen.sparkSession.sparkContext.broadcast(b"".join(parts.get(s, bytes(bits // SLICES // 8)) for s in range(SLICES)))


def bits_for(n: int, max_bits: int) -> int:
    return min(max_bits, max(1 << 16, 1 << (n * BITS_A_KEY - 1).bit_length()))


def hits_of(filter_, bits: int):
    """Whether hashes are in the filter, for arrays of them."""
    flags = np.unpackbits(np.frombuffer(filter_.value, dtype=np.uint8)).view(bool) if bits <= 1 << 24 else None
    packed = np.frombuffer(filter_.value, dtype=np.uint8)

    def hit(p):
        return flags[p] if flags is not None else (packed[p >> np.uint64(3)] >> (np.uint64(7) - (p & np.uint64(7))).astype(np.uint8)) & 1 > 0

    def run(hashes):
        p = positions(hashes, bits)
        return hit(p[0]) & hit(p[1])

    return run


def among(filter_, bits: int, wanted: bool, key: str):
    """The rows whose ``key`` is in the filter, or isn't."""

    def run(batches):
        hits = hits_of(filter_, bits)
        for batch in batches:
            yield batch.filter(pa.array(hits(batch.column(key).to_numpy().view(np.uint64)) == wanted))

    return run
