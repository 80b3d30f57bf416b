"""Hashed word shingles of many whole texts at once."""

from __future__ import annotations

import numpy as np

WIDTH = 5
#: Bytes looked at in one go; a longer text is taken in windows that end at white space.
WINDOW = 1 << 20

_CHANCE = np.random.Generator(np.random.PCG64(20240229))
_BYTES = _CHANCE.integers(1, 1 << 63, 256, np.uint64) << np.uint64(1) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTES[_SPACE] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_PLACES = _CHANCE.integers(1, 1 << 63, 4096, np.uint64) << np.uint64(1) | np.uint64(1)
_WORDS = _CHANCE.integers(1, 1 << 63, 2 * WIDTH, np.uint64) << np.uint64(1) | np.uint64(1)


def mixed(values: np.ndarray, salt: int = 0) -> np.ndarray:
    """Well-mixed 64-bit values (the finaliser of splitmix64)."""
    values = values + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) % (1 << 64))
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word ``[^\\x20\\x09-\\x0D]+``, A-Z as a-z, and where it starts."""
    whole = np.frombuffer(data, np.uint8)
    hashes, places, low = [], [], 0
    while low < len(whole):
        high = min(low + WINDOW, len(whole))
        while high < len(whole) and not _SPACE[whole[high]]:
            step = np.flatnonzero(_SPACE[whole[high : high + WINDOW]])
            high = high + int(step[0]) if len(step) else min(high + WINDOW, len(whole))
        part = whole[low:high]
        inside = ~_SPACE[part]
        starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
        if len(starts):
            place = np.arange(starts[0], len(part)) - np.repeat(starts, np.diff(np.append(starts, len(part))))
            values = mixed(_BYTES[_LOWER[part[starts[0] :]]] * _PLACES[place % len(_PLACES)])
            values[~inside[starts[0] :]] = 0
            hashes.append(mixed(np.add.reduceat(values, starts - starts[0])))
            places.append(starts + low)
        low = high
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(places)


def shingle_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all 5-word shingles, repeats included, and the offsets of the texts.

    A text of fewer words has its whole sequence as one shingle, a text without words none.
    """
    words, places = word_hashes(b"\n".join(texts))
    ends = np.cumsum([len(text) + 1 for text in texts])
    edges = np.concatenate([[0], np.searchsorted(places, ends)])
    counts = np.diff(edges)
    sizes = np.where(counts >= WIDTH, counts - WIDTH + 1, np.minimum(counts, 1))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    padded = np.concatenate([words, np.zeros(WIDTH, np.uint64)])
    full = np.zeros(len(words), np.uint64)
    for k in range(WIDTH):
        full += padded[k : k + len(words)] * _WORDS[k]
    # The first words of a text start its shingles, all but the last four.
    first = np.repeat(edges[:-1], sizes) + np.arange(offsets[-1]) - np.repeat(offsets[:-1], sizes)
    found = mixed(full[first]) if len(first) else np.zeros(0, np.uint64)
    for text in np.flatnonzero((counts > 0) & (counts < WIDTH)):
        own = words[edges[text] : edges[text + 1]]
        found[offsets[text]] = mixed((own * _WORDS[WIDTH : WIDTH + len(own)]).sum(keepdims=True), len(own))[0]
    return found, offsets


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingles of every text."""
    found, offsets = shingle_hashes(texts)
    return [np.unique(found[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
