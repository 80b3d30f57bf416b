"""Approximate nearest neighbours by randomly rotated one-bit codes (operator 3).

A unit vector is padded, turned by a fixed random rotation and kept as the signs of
its coordinates, packed into 64-bit words, with one correction scalar: the product of
the turned vector with the direction of its own code. Against a query, turned alike
and rounded at random to four-bit numbers, the product of code and query is a handful
of bit counts; divided by the scalar it estimates the cosine without bias, with an error
whose size is known.

Codes and vectors stay where they were written. Queries are cut into chunks of bounded
bytes, and a chunk goes to every task of a scan. Lower bounds on one code in
``FLOOR_SHARE`` give a query its floor first: the k-th best of any codes is one. Then all
codes are scanned: a vector whose upper bound reaches the floor gets its exact cosine in
place, and a task raises the floor by the k best that it has found. What is shuffled is at
most k rows of a query and task, of vectors that reach the floor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .tiled_cosine import by_length, matrix, units, usable

#: Bits of a code for each dimension of the vectors.
BITS_EACH = 8
#: Width of the error bounds in standard deviations.
WIDTH = 3.0
PLANES = 4
#: Bytes of the queries that go to the tasks at once.
QUERY_BYTES = 8 << 20
#: Codes scanned side by side, and the bytes of their vectors, at most.
BLOCK = 8192
BLOCK_BYTES = 16 << 20
#: One code in this many gives the first floors.
FLOOR_SHARE = 16
#: Bounds and exact cosines of one pair may differ by rounding.
SLACK = 1e-9
SEED = 3


def rotation(length: int, seed: int = SEED, bits_each: int = BITS_EACH) -> np.ndarray:
    """``length`` orthonormal rows in the space of the code: a random rotation of padded vectors."""
    size = -(-max(bits_each * length, 64) // 64) * 64
    chance = np.random.Generator(np.random.PCG64([seed, length]))
    return np.linalg.qr(chance.standard_normal((size, length)))[0].T.copy()


def coded(rows: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits of the turned unit vectors, and their correction scalars."""
    turned = units(rows) @ turn
    signs = turned > 0
    size = turn.shape[1]
    scalar = np.where(signs, turned, -turned).sum(axis=1) / np.sqrt(size)
    return np.packbits(signs, axis=1, bitorder="little").view("<u8"), scalar


@dataclass
class Rounded:
    """A turned unit query in four-bit numbers: bit planes, and how to read them."""

    planes: np.ndarray
    low: float
    step: float
    total: int


def rounded(turned: np.ndarray, chance: np.random.Generator) -> Rounded:
    """The query rounded at random to one of its neighbours, so that sums have no bias."""
    levels = (1 << PLANES) - 1
    low = turned.min()
    step = max((turned.max() - low) / levels, 1e-300)
    found = np.clip(np.floor((turned - low) / step + chance.random(len(turned))), 0, levels).astype(np.uint8)
    planes = [np.packbits(found >> plane & 1, bitorder="little").view("<u8") for plane in range(PLANES)]
    return Rounded(np.array(planes), float(low), float(step), int(found.sum()))


class Scan:
    """Estimates of many codes for one query after the other."""

    def __init__(self, words: np.ndarray, scalars: np.ndarray):
        # One row for each word of a code, so that bit counts run along the codes.
        self.words, self.scalars = np.ascontiguousarray(words.T), scalars
        self.size = words.shape[1] * 64
        self.bits = np.bitwise_count(self.words).sum(axis=0, dtype=np.int64)
        # Spread of the part of a query that the code says nothing of.
        self.error = WIDTH * np.sqrt(np.maximum(1 - scalars**2, 0) / scalars**2 / (self.size - 1))
        self.grain = WIDTH / np.sqrt(self.size) / scalars
        self.scale = 1 / np.sqrt(self.size) / scalars

    def cosines(self, query: Rounded) -> tuple[np.ndarray, np.ndarray]:
        """Estimated cosines with the query, and the width of their bounds."""
        product = np.zeros(self.words.shape[1], np.int64)
        for plane in range(PLANES):
            counts = np.bitwise_count(self.words & query.planes[plane][:, None]).sum(axis=0, dtype=np.uint32)
            product += counts.astype(np.int64) << plane
        # Sum of +-1 times the rounded query, from the sums over set bits.
        signed = 2 * (query.step * product + query.low * self.bits) - (query.step * query.total + query.low * self.size)
        return signed * self.scale, self.error + query.step * self.grain


def build_index(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", seed: int = SEED, bits_each: int = BITS_EACH
) -> DataFrame:
    """``key, vector, length, words binary, scalar`` of every usable vector; nothing is fitted or sampled."""
    own = vectors.select(vectors[key].cast("long").alias("key"), vectors[vector].alias("vector"))
    own = own.filter(usable(F.col("vector")) & F.col("key").isNotNull())
    own = own.select("key", F.transform("vector", lambda x: x.cast("double") + 0.0).alias("vector"))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            for part in by_length(batch, "vector"):
                rows = matrix(part.column("vector"))
                size = rows.shape[1]
                if size not in turns:
                    turns[size] = rotation(size, seed, bits_each)
                words, scalars = coded(rows, turns[size])
                packed = pa.array([row.tobytes() for row in words], pa.binary())
                columns = [part.column("key"), part.column("vector"), pa.array([size] * len(rows), pa.int32()), packed, pa.array(scalars)]
                yield pa.RecordBatch.from_arrays(columns, ["key", "vector", "length", "words", "scalar"])

    return own.mapInArrow(code, "key long, vector array<double>, length int, words binary, scalar double")


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    key: str = "vec_id",
    vector: str = "embedding",
    seed: int = SEED,
    bits_each: int = BITS_EACH,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows of each query, by cosine.

    ``queries`` has the columns of ``vectors``; a row is never its own neighbour, told by
    the key. The cosine is exact, on the original vectors, in double precision; ties go
    to the smaller key. Vectors that are null, empty, zero or hold null or non-finite
    components, and null keys, take no part; vectors of another length than the query's
    are no candidates. Fewer candidates give fewer rows, none gives none. A key that
    repeats is one row, the first of its vectors in order. Other columns are ignored.
    """
    spark = vectors.sparkSession
    index = build_index(vectors, key, vector, seed, bits_each)
    index = index.withColumn("low", F.xxhash64("vector")).withColumn("high", F.xxhash64(F.lit(1), "vector"))
    index = materialise(index, "codes")
    # Of equal vectors only the first k + 1 keys can be among anyone's k nearest.
    place = F.row_number().over(Window.partitionBy("length", "low", "high").orderBy("key"))
    index = materialise(index.withColumn("copy", place).filter(F.col("copy") <= k + 1).drop("copy", "low", "high"), "index")
    repeated = index.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    if not repeated.isEmpty():
        first = F.row_number().over(Window.partitionBy("key").orderBy("vector"))
        index = materialise(index.withColumn("copy", first).filter("copy = 1").drop("copy"), "index")
    asked = queries.select(queries[key].cast("long").alias("query_id"), queries[vector].alias("asked"))
    asked = asked.filter(usable(F.col("asked")) & F.col("query_id").isNotNull())
    asked = asked.groupBy("query_id").agg(F.min(F.transform("asked", lambda x: x.cast("double") + 0.0)).alias("asked"))
    chunks = _chunks(materialise(asked, "queries"), seed, bits_each)
    # Codes of the first floors in files of their own, so that few tasks read them.
    some = index.filter(F.pmod(F.xxhash64("key"), F.lit(FLOOR_SHARE)) == 0).select("key", "length", "words", "scalar")
    some = materialise(some, "some-codes")
    found = []
    for chunk in chunks:
        held = _held(chunk)
        if not held:
            continue
        bounds = some.mapInArrow(_floors(held, k), "query_id long, bound double")
        floors = materialise(bounds.groupBy("query_id").agg(F.max("bound").alias("floor")), "floors")
        for floor in floors.toLocalIterator():
            held[floor["query_id"]].floor = floor["floor"]
        exact = index.select("key", "vector", "length", "words", "scalar")
        found.append(materialise(exact.mapInArrow(_reranked(held, k), "query_id long, vec_id long, score double"), "found"))
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", order)
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@dataclass
class Asked:
    """A query as the tasks get it: its rounded form, its vector, and the floor it has."""

    rounded: Rounded
    vector: np.ndarray
    norm: float
    floor: float = -np.inf


def _scaled(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose largest component is 1, and their norms, so that no component overflows or vanishes."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows, np.sqrt((rows * rows).sum(axis=1))


def _chunks(asked: DataFrame, seed: int, bits_each: int) -> Iterator[DataFrame]:
    """Rounded queries in tables whose vectors and bit planes take about ``QUERY_BYTES``."""

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            for part in by_length(batch, "asked"):
                rows = matrix(part.column("asked"))
                size = rows.shape[1]
                if size not in turns:
                    turns[size] = rotation(size, seed, bits_each)
                keys = part.column("query_id").to_pylist()
                # The rounding is random, yet the same on every run.
                made = [
                    rounded(row, np.random.Generator(np.random.PCG64([seed, key % (1 << 63)])))
                    for key, row in zip(keys, units(rows) @ turns[size], strict=True)
                ]
                columns = [
                    part.column("query_id"), part.column("asked"),
                    pa.array([query.planes.tobytes() for query in made], pa.binary()),
                    pa.array([query.low for query in made]), pa.array([query.step for query in made]),
                    pa.array([query.total for query in made], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "asked", "planes", "low", "step", "total"])

    kinds = "query_id long, asked array<double>, planes binary, low double, step double, total long"
    turned = materialise(asked.mapInArrow(turn, kinds), "turned")
    size = turned.agg(F.sum(F.size("asked") * 8 + F.octet_length("planes"))).first()[0] or 0
    n = -(-size // QUERY_BYTES)
    if n > 1:
        # In the order of chunks, so that reading one skips the row groups of others.
        turned = turned.withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(n)))
        turned = materialise(turned.repartitionByRange("chunk").sortWithinPartitions("chunk"), "chunks")
    return (turned.filter(F.col("chunk") == i).drop("chunk") if n > 1 else turned for i in range(n))


def _held(chunk: DataFrame) -> dict[int, Asked]:
    """The queries of one chunk, whose bytes are bounded, on their way to the tasks."""
    held = {}
    for row in chunk.toLocalIterator():
        scaled, norms = _scaled(np.array([row["asked"]]))
        planes = np.frombuffer(bytes(row["planes"]), "<u8").reshape(PLANES, -1)
        held[row["query_id"]] = Asked(Rounded(planes, row["low"], row["step"], row["total"]), scaled[0], norms[0])
    return held


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, Scan]]:
    """Codes of one length, up to ``BLOCK`` or ``BLOCK_BYTES`` together: rows, keys and their scan."""

    def cut(held: list[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, Scan]]:
        rows = pa.Table.from_batches(held)
        lengths = np.array(rows.column("length"))
        for length in np.unique(lengths):
            part = rows.filter(pa.array(lengths == length))
            keys = np.array(part.column("key"))
            words = np.frombuffer(b"".join(part.column("words").to_pylist()), "<u8").reshape(len(keys), -1)
            yield part, keys, Scan(words, np.array(part.column("scalar")))

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) >= BLOCK or sum(b.nbytes for b in held) >= BLOCK_BYTES:
            yield from cut(held)
            held = []
    if held:
        yield from cut(held)


def _floors(held: dict[int, Asked], k: int) -> Callable:
    """``query_id, bound``: the k-th best lower bound that a task's codes give a query."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {query_id: np.full(k, -np.inf) for query_id in held}
        for part, keys, codes in _blocks(batches):
            length = part.column("length")[0].as_py()
            for query_id, query in held.items():
                if len(query.vector) != length:
                    continue
                estimate, width = codes.cosines(query.rounded)
                bound = np.concatenate([best[query_id], (estimate - width)[keys != query_id]])
                best[query_id] = np.partition(bound, -k)[-k:]
        bounds = [(query_id, found.min()) for query_id, found in best.items() if np.isfinite(found.min())]
        ids, values = [pair[0] for pair in bounds], [pair[1] for pair in bounds]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(values, pa.float64())], ["query_id", "bound"])

    return scan


def _reranked(held: dict[int, Asked], k: int) -> Callable:
    """``query_id, vec_id, score``: a task's k nearest of a query, of those that reach its floor."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors = {query_id: query.floor for query_id, query in held.items()}
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for part, keys, codes in _blocks(batches):
            length = part.column("length")[0].as_py()
            vectors, norms = _scaled(matrix(part.column("vector").combine_chunks()))
            for query_id, query in held.items():
                if len(query.vector) != length:
                    continue
                estimate, width = codes.cosines(query.rounded)
                at = np.flatnonzero((estimate + width >= floors[query_id] - SLACK) & (keys != query_id))
                if not len(at):
                    continue
                scores = (query.vector * vectors[at]).sum(axis=1) / (query.norm * norms[at])
                old_keys, old_scores = best.get(query_id, (keys[:0], scores[:0]))
                near, scores = np.concatenate([old_keys, keys[at]]), np.concatenate([old_scores, scores])
                first = np.lexsort((near, -scores))[:k]
                best[query_id] = near[first], scores[first]
                if len(first) == k:
                    floors[query_id] = max(floors[query_id], scores[first[-1]])
        ids = [np.full(len(near), query_id) for query_id, (near, _) in best.items()]
        columns = [ids, [near for near, _ in best.values()], [scores for _, scores in best.values()]]
        kinds = [pa.int64(), pa.int64(), pa.float64()]
        arrays = [pa.array(np.concatenate(c) if c else [], kind) for c, kind in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, ["query_id", "vec_id", "score"])

    return scan
