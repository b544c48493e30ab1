"""64-bit hashes of words and of runs of words, for many texts at once in numpy.

A word's hash is a polynomial over random numbers, one for each byte value, modulo 2^64, mixed at the end. Two
different words, or runs of words, share a hash with a chance of about 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes hashed at a time; longer texts are cut between words.
PIECE = 1 << 20

# White space of `[^\x20\x09-\x0D]+` becomes a space; the second table also lower-cases A-Z.
SPACED = bytes(32 if 9 <= b <= 13 else b for b in range(256))
SPACED_LOWER = bytes(32 if 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))

_BASE = np.uint64(0x9E3779B97F4A7C15)
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_VALUES[32] = 0
_FACTORS = np.random.default_rng(7).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _pieces(joined: bytes) -> Iterator[tuple[int, int]]:
    start = 0
    while start < len(joined):
        end = min(start + PIECE, len(joined))
        if end < len(joined):
            cut = joined.rfind(b" ", start, end)
            end = cut + 1 if cut >= start else (joined.find(b" ", end) + 1 or len(joined))
        yield start, end
        start = end


def word_hashes(texts: list[str], table: bytes = SPACED) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of all texts in order, and the number of words of each text."""
    raw = [t.encode("utf-8", "surrogatepass").translate(table) for t in texts]
    joined = b" ".join(raw)
    hashes, places = [], []
    for start, end in _pieces(joined):
        data = np.frombuffer(joined, np.uint8, end - start, start)
        solid = data != 32
        first = np.flatnonzero(solid & np.concatenate([[True], ~solid[:-1]]))
        if not len(first):
            continue
        data = data[first[0]:]
        begin = first - first[0]
        inside = np.arange(len(data)) - np.repeat(begin, np.diff(np.append(begin, len(data))))
        powers = np.full(int(inside.max()) + 1, _BASE)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        hashes.append(mix(np.add.reduceat(_VALUES[data] * powers[inside], begin)))
        places.append(first + start)
    place = np.concatenate(places) if places else np.zeros(0, np.int64)
    ends = np.cumsum([len(r) + 1 for r in raw]) if raw else np.zeros(0, np.int64)
    upto = np.searchsorted(place, ends)
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.diff(upto, prepend=0)


def runs(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of every n words that follow each other (over the ends of texts too)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    size = len(words) - n + 1
    total = np.zeros(size, np.uint64)
    for i in range(n):
        total += words[i:i + size] * _FACTORS[i]
    return mix(total + _FACTORS[-n])
