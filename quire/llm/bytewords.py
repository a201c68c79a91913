"""64-bit hashes of white-space words, computed over the bytes of many texts at once with numpy."""

from __future__ import annotations

import numpy as np

# The white-space bytes, of which UTF-8 has none inside a character.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_RNG = np.random.default_rng(20240229)
#: A random number for each byte value, and the odd factor between neighbouring places.
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
#: Byte -> byte with A-Z lower-cased.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that are hashed at once.
SLICE = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit number over all bits (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(max(0, n - 1), _STEP)]))


def _hash_bytes(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    solid = ~_IS_SPACE[data]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    first = (np.cumsum(sizes) - sizes)[sizes > 0]
    begin[first] = solid[first]  # a text's first byte never continues a word
    word = np.cumsum(begin, dtype=np.int64)
    per = np.zeros(len(sizes), np.int64)
    if len(first):
        last = first + sizes[sizes > 0] - 1
        before = np.where(first > 0, word[first - 1], 0)
        per[sizes > 0] = word[last] - before
    bytes_ = data[solid]
    if not len(bytes_):
        return np.zeros(0, np.uint64), per
    starts = np.flatnonzero(begin[solid])
    lengths = np.diff(starts, append=len(bytes_))
    place = np.arange(len(bytes_)) - np.repeat(starts, lengths)
    parts = _BYTE[bytes_] * _powers(int(lengths.max()))[place]
    return mix(np.add.reduceat(parts, starts) + lengths.astype(np.uint64)), per


def hash_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lower-cased, one text after the other; and the number of words of each text."""
    hashes, counts, group, held = [], [], [], 0

    def flush():
        if group:
            data = LOWER[np.frombuffer(b"".join(group), np.uint8)]
            h, n = _hash_bytes(data, np.array([len(t) for t in group], np.int64))
            hashes.append(h)
            counts.append(n)

    for t in texts:
        if held + len(t) > SLICE and group:
            flush()
            group, held = [], 0
        group.append(t)
        held += len(t)
    flush()
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.concatenate(counts) if counts else np.zeros(0, np.int64))
