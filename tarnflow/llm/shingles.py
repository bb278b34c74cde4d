"""Word shingles of whole texts as 64-bit hashes, many documents at a time."""

from __future__ import annotations

import numpy as np
import xxhash

#: Bytes of text that are hashed at once.
CHUNK = 512 << 10
_rng = np.random.default_rng(0x5EED)
_BYTE = _rng.integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def _power(which: str, n: int) -> np.ndarray:
    if len(_powers[which]) < n:
        x = np.full(max(n, CHUNK + (64 << 10)), _BASE if which == "up" else _INVERSE, dtype=np.uint64)
        x[0] = 1
        _powers[which] = np.multiply.accumulate(x)
    return _powers[which][:n]


def _word_hashes(raw: np.ndarray, starts_of_docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for every word (A-Z lower-cased) and the place where it starts; no word crosses into the next document."""
    solid = ~_WHITE[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = starts_of_docs[(starts_of_docs > 0) & (starts_of_docs < len(raw))]
    first[inner] = solid[inner]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | first[1:]
    begin, end = np.flatnonzero(first), np.flatnonzero(last)
    total = np.empty(len(raw) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[_LOWER[raw]] * _power("up", len(raw)), out=total[1:])
    h = (total[end + 1] - total[begin]) * _power("down", len(raw))[begin]
    return mix(h ^ (end - begin + 1).astype(np.uint64)), begin


def shingle_sets(texts: list[bytes], size: int = 5):
    """For each text its distinct shingle hashes, sorted: runs of ``size`` words, or the whole sequence if shorter; none without words."""
    at = 0
    while at < len(texts):
        end, held = at, 0
        while end < len(texts) and (end == at or held + len(texts[end]) <= CHUNK):
            held += len(texts[end])
            end += 1
        part = texts[at:end]
        offsets = np.cumsum([0, *map(len, part)])
        raw = np.frombuffer(b"".join(part), dtype=np.uint8)
        if len(raw):
            words, begin = _word_hashes(raw, offsets)
            bounds = np.searchsorted(begin, offsets)
            runs = np.zeros(max(0, len(words) - size + 1), dtype=np.uint64)
            for k in range(size):
                runs = runs * _BASE + words[k : k + len(runs)]
            runs = mix(runs)
        for i in range(len(part)):
            a, b = (bounds[i], bounds[i + 1]) if len(raw) else (0, 0)
            if b - a >= size:
                yield np.unique(runs[a : b - size + 1])
            elif b > a:
                yield np.array([xxhash.xxh3_64_intdigest(words[a:b].tobytes())], dtype=np.uint64)
            else:
                yield np.zeros(0, dtype=np.uint64)
        at = end


def set_key(hashes: np.ndarray) -> int:
    """A signed 64-bit name of a set of hashes."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).astype(np.int64))
