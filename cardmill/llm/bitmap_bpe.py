"""Byte-level BPE by a rank queue of hierarchical bitmaps (operator 7).

Every merge rank has a bucket with the positions of its pairs in a linked list of
parts. Three levels of bitmaps tell which buckets hold something; the next rank is
the first set bit, found in three steps however many ranks there are. A position
whose pair has changed meanwhile is stale and is skipped. A merge costs a few steps
whatever the length of the pre-token, so one of a million bytes takes time in
proportion.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow import flat_bytes, lists, ragged, text_slices, type_of
from .chunks import Chunks, cut_words, splitter

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Bytes of texts or ids that are worked on at once.
SLICE = 1 << 20


class RankQueue:
    """Buckets of positions by rank; ``first`` is the lowest rank that has any."""

    def __init__(self, ranks: int):
        self.words = [0] * (ranks // 64 + 1)
        self.groups = [0] * (len(self.words) // 64 + 1)
        self.top = 0
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Positions into the buckets of their ranks, a slice per bucket."""
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        edges = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
        for rank, low, high in zip(ranks[edges[:-1]].tolist(), edges, edges[1:], strict=False):
            bucket = self.buckets.get(rank)
            if bucket is not None:
                bucket.append(positions[low:high])
                continue
            self.buckets[rank] = [positions[low:high]]
            word, group = rank >> 6, rank >> 12
            self.words[word] |= 1 << (rank & 63)
            self.groups[group] |= 1 << (word & 63)
            self.top |= 1 << group

    def first(self) -> int:
        """The lowest rank, -1 if the queue is empty."""
        if not self.top:
            return -1
        group = (self.top & -self.top).bit_length() - 1
        bits = self.groups[group]
        word = group << 6 | (bits & -bits).bit_length() - 1
        bits = self.words[word]
        return word << 6 | (bits & -bits).bit_length() - 1

    def pop(self, rank: int) -> np.ndarray:
        """All positions of a rank."""
        word, group = rank >> 6, rank >> 12
        self.words[word] &= ~(1 << (rank & 63))
        if not self.words[word]:
            self.groups[group] &= ~(1 << (word & 63))
            if not self.groups[group]:
                self.top &= ~(1 << group)
        return np.concatenate(self.buckets.pop(rank))


class Merger:
    """Encodes pre-tokens by a rank file, many at once in one queue.

    The parts of all pre-tokens lie in one linked list with a wall before each
    pre-token. A merge never reaches over a wall, so taking the lowest rank of the
    whole list gives each pre-token the merges it would get alone, while the
    positions of one rank are merged together.
    """

    WALL, GONE = -1, -2

    def __init__(self, path: str = RANKS):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.bytes = np.array([self.ranks[bytes([value])] for value in range(256)], np.int64)
        self.base = max(self.ranks.values()) + 1
        known = self.ranks.get
        joins = sorted(
            (left * self.base + right, rank)
            for token, rank in self.ranks.items()
            for cut in range(1, len(token))
            if (left := known(token[:cut])) is not None and (right := known(token[cut:])) is not None
        )
        self.keys = np.array([key for key, _ in joins] + [np.iinfo(np.int64).max], np.int64)
        self.values = np.array([rank for _, rank in joins] + [-1], np.int64)
        self.queue = RankQueue(self.base)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of neighbours as one token, -1 where there is none."""
        keys = left * self.base + right
        at = np.searchsorted(self.keys, keys)
        return np.where((self.keys[at] == keys) & (left >= 0) & (right >= 0), self.values[at], -1)

    def encode(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all tokens and how many each has."""
        data = [token.encode() for token in tokens]
        whole = [self.ranks.get(value, -1) for value in data]
        rest = [value for value, rank in zip(data, whole, strict=True) if rank < 0]
        lengths = np.ones(len(tokens), np.int64)
        at = np.array(whole, np.int64) < 0
        ids, sizes = self._merge(rest)
        lengths[at] = sizes
        flat = np.empty(int(lengths.sum()), np.int64)
        starts = np.cumsum(lengths) - lengths
        flat[starts[~at]] = np.array(whole, np.int64)[~at]
        flat[ragged(starts[at], sizes)] = ids
        return flat, lengths

    def _merge(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer(b"".join(tokens), np.uint8)
        sizes = np.array([len(token) for token in tokens], np.int64)
        # A wall before every token, and one at the end.
        walls = np.append(np.cumsum(sizes + 1) - sizes - 1, len(raw) + len(tokens))
        parts = np.full(len(raw) + len(tokens) + 1, self.WALL, np.int64)
        parts[ragged(walls[:-1] + 1, sizes)] = self.bytes[raw]
        after, before = np.arange(1, len(parts) + 1), np.arange(-1, len(parts) - 1)
        # The rank of the pair that starts at a position; -1 where none does.
        joins = np.append(self._pairs(parts[:-1], parts[1:]), -1)
        queue = self.queue
        start = np.flatnonzero(joins >= 0)
        queue.push(joins[start], start)
        while (rank := queue.first()) >= 0:
            at = queue.pop(rank)
            at = at[joins[at] == rank]
            if len(at) > 1:
                at = self._apart(np.unique(at), after)
            if not len(at):
                continue
            gone = after[at]
            follows = after[gone]
            parts[at], parts[gone], joins[gone] = rank, self.GONE, -1
            after[at], before[follows] = follows, at
            ahead = before[at]
            changed = np.concatenate([at, ahead])
            new = joins[changed] = self._pairs(parts[changed], parts[after[changed]])
            queue.push(new[new >= 0], changed[new >= 0])
        left = parts >= 0
        return parts[left], np.add.reduceat(left, walls[:-1]).astype(np.int64) if len(tokens) else sizes

    @staticmethod
    def _apart(at: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Leftmost first, without pairs that share a part: every other one of a run of equal parts."""
        touches = after[at[:-1]] == at[1:]
        if not touches.any():
            return at
        place = np.arange(len(at))
        run = np.maximum.accumulate(np.where(np.append(False, touches), 0, place))
        return at[(place - run) % 2 == 0]


#: One per Python worker and rank file: the table of chunks pays off over all batches of a task and the next ones.
_POOLS: dict[tuple[str, str], Chunks] = {}


def _pool(path: str, pattern: str) -> Chunks:
    if (path, pattern) not in _POOLS:
        merger, split = Merger(path), splitter(pattern)

        def encode(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            matches = [split.findall(chunk.decode("utf-8", "replace")) for chunk in chunks]
            ids, sizes = merger.encode([match for own in matches for match in own])
            ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *map(len, matches)])]
            return ids.astype(np.uint32), np.diff(ends)

        _POOLS[path, pattern] = Chunks(cut_words, encode)
    return _POOLS[path, pattern]


class Decoder:
    """Bytes of ids by rank."""

    def __init__(self, path: str = RANKS):
        with open(path, "rb") as lines:
            table = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
        tokens = [table.get(rank, b"") for rank in range(max(table) + 1)]
        self.lengths = np.array([len(token) for token in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The bytes of each run of ids."""
        lengths = self.lengths[ids]
        data = self.flat[ragged(self.starts[ids], lengths)].tobytes()
        edges = np.concatenate([[0], np.cumsum(lengths)])[offsets].tolist()
        return pa.array([data[a:b] for a, b in zip(edges, edges[1:])], pa.binary())  # noqa: B905


def encode_bpe(
    docs: DataFrame, path: str = RANKS, pattern: str = public_tokenizers.PATTERN, key: str = "doc_id", text: str = "text",
    decoded: bool = False,
) -> DataFrame:
    """``key`` and ``ids array<int>``: the ids of every whole text, one row per row of ``docs``.

    With ``decoded`` also the bytes that the ids decode to, as ``decode_bpe`` adds them, in the
    same stage: ids need not go to Python once more. Nothing is shuffled. Null and empty texts
    have no ids; a null key and repeated rows stay as they are; other columns are ignored,
    whatever their names. ``path`` must be readable on all executors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool, decoder = _pool(path, pattern), Decoder(path) if decoded else None
        for batch in text_slices(batches, 1, SLICE):
            ids, offsets = pool.encode_all(*flat_bytes(batch.column(1)))
            columns, names = [batch.column(0), lists(ids.astype(np.int32), offsets)], [key, "ids"]
            if decoder:
                columns, names = [*columns, decoder.decode(ids, offsets)], [*names, "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    more = ", decoded binary" if decoded else ""
    return docs.select(key, text).mapInArrow(run, f"`{key}` {type_of(docs, key)}, ids array<int>{more}")


def decode_bpe(encoded: DataFrame, path: str = RANKS, key: str = "doc_id") -> DataFrame:
    """``encoded`` with ``decoded binary``: the bytes of the ids. Null ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(path)
        for batch in text_slices(batches, 1, SLICE):
            ids = batch.column(1)
            sizes = np.array([size or 0 for size in ids.value_lengths().to_pylist()], np.int64)
            at = ids.flatten().to_numpy(zero_copy_only=False)
            decoded = decoder.decode(at, np.concatenate([[0], np.cumsum(sizes)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, decoded], [key, "ids", "decoded"])

    return encoded.select(key, "ids").mapInArrow(
        run, f"`{key}` {type_of(encoded, key)}, ids array<int>, decoded binary"
    )
