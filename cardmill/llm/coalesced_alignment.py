"""Alignment of two tokenizers' tokens by interval coalescing (operator 12).

A token is the interval of bytes that it covers. The intervals of both sides are sorted by
start, a running maximum of their ends goes along, and a group breaks where a start
reaches it; within a group, every interval meets those of the other side that it overlaps.
All texts of a batch are one line of bytes, so this is a handful of array operations.

An aligned document is its ids on both sides, little-endian in as many bytes as the larger
vocabulary takes (``id_kind``), and ``steps``, one byte for each link in order:
1 if a token of A starts with the link, 2 if one of B does, 3 if both do, which starts a
group. How often two ids are linked is counted per task, then by Spark. The most frequent
links, at most ``HOT`` of them, go to all tasks with their counts; the others meet the table
of counts in a join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, new_dir
from .arrow import flat_bytes, ragged, text_slices, type_of
from .chunks import CHANGED, byte_bpe, byte_tokens, piece_tokens, sentence_pieces
from .lookup import Lookup

A = public_tokenizers.path("byte_bpe_50k.json")
B = public_tokenizers.path("piece_bpe_32k.model")
#: Bytes of text, or of ids, that are worked on at once.
TEXT, IDS = 2 << 20, 1 << 19
#: Links whose counts every task gets, and links or kinds of links that a task counts at once.
HOT, COUNTED = 1 << 20, 4 << 20
#: Steps of the logarithm in which the frequent links are told from the others.
FINE = 64


def _spaced(flat: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts that are not empty with a space before them."""
    sizes = np.diff(edges)
    starts = np.concatenate([[0], np.cumsum(sizes + (sizes > 0))])
    out = np.full(starts[-1], 32, np.uint8)
    out[ragged(starts[:-1] + 1, sizes)] = flat
    return out, starts


def coalesce(starts_a: np.ndarray, ends_a: np.ndarray, starts_b: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """``steps`` of two coverings of the same bytes by intervals in order, none of them empty."""
    starts, ends = np.concatenate([starts_a, starts_b]), np.concatenate([ends_a, ends_b])
    side = np.repeat(np.array([1, 2], np.uint8), [len(starts_a), len(starts_b)])
    order = np.lexsort((side, starts))
    starts, side = starts[order], side[order]
    reached = np.maximum.accumulate(ends[order])
    opens = np.ones(len(starts), bool)
    opens[1:] = starts[1:] >= reached[:-1]
    # Within a group a start opens a link with what lies on the other side; two starts at one byte open it together.
    first = np.ones(len(starts), bool)
    first[1:] = starts[1:] != starts[:-1]
    at = np.flatnonzero(first)
    if not len(at):
        return np.zeros(0, np.uint8)
    steps = np.bitwise_or.reduceat(side, at)
    if ((steps == 3) != opens[at]).any():
        raise ValueError("the two sides do not cover the same bytes")
    return steps


def id_kind(path_a: str = A, path_b: str = B) -> np.dtype:
    """The type of the ids of two tokenizers in an aligned table."""
    return np.dtype("<u2" if max(len(byte_tokens(path_a)), len(piece_tokens(path_b))) <= 1 << 16 else "<u4")


def align_tokens(docs: DataFrame, path_a: str = A, path_b: str = B, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, a_ids, b_ids, steps`` (see above), one row per row of ``docs``.

    A is a byte-level BPE of the tokenizers library and reads a space and the text, B a
    SentencePiece model, which adds the space. Special tokens in texts are plain text. Texts that
    are null or empty, or that the tokens of a side do not give back, have no tokens. A null
    key and repeated rows stay as they are; other columns are ignored, whatever their names.
    """

    wide = id_kind(path_a, path_b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pools = byte_bpe(path_a), sentence_pieces(path_b)
        sizes = [np.array([len(token) for token in own(path)], np.int64) for own, path in ((byte_tokens, path_a), (piece_tokens, path_b))]
        for batch in text_slices(batches, 1, TEXT):
            flat, edges = _spaced(*flat_bytes(batch.column(1)))
            found, given = [pool.encode_all(flat, edges) for pool in pools], np.ones(len(edges) - 1, bool)
            widths = []
            for (ids, offsets), size in zip(found, sizes, strict=True):
                known = ids != CHANGED
                widths.append(size[np.where(known, ids, 0)])
                covered = np.concatenate([[0], np.cumsum(np.where(known, widths[-1], 0))])[offsets]
                given &= (np.diff(covered) == np.diff(edges)) & (np.diff(np.concatenate([[0], np.cumsum(known)])[offsets]) == np.diff(offsets))
            sides, ends = [], []
            for (ids, offsets), width in zip(found, widths, strict=True):
                kept = np.repeat(given, np.diff(offsets))
                sides.append((ids[kept], np.concatenate([[0], np.cumsum(np.where(given, np.diff(offsets), 0))])))
                ends.append(np.cumsum(width[kept]))
            starts = [np.concatenate([[0], end[:-1]]) if len(end) else end for end in ends]
            steps = coalesce(starts[0], ends[0], starts[1], ends[1])
            # A document starts with the link of its first token of A.
            heads = np.append(np.flatnonzero(steps & 1), len(steps))[sides[0][1]]
            data = [
                pa.array([own[a:b].astype(wide).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
                for own, at in sides
            ]
            data.append(pa.array([steps[a:b].tobytes() for a, b in zip(heads[:-1], heads[1:], strict=True)], pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *data], [key, "a_ids", "b_ids", "steps"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {type_of(docs, key)}, a_ids binary, b_ids binary, steps binary")


def _sides(batch: pa.RecordBatch, column: int, kind: np.dtype) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
    """Ids of A and of B and the steps, each with the edges of the documents."""
    sides = []
    for k in range(3):
        flat, edges = flat_bytes(batch.column(column + k))
        sides.append((np.frombuffer(flat.tobytes(), kind), edges // kind.itemsize) if k < 2 else (flat, edges))
    return tuple(sides)


def _pairs(a: np.ndarray, b: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Every link as one number, the id of A above the id of B."""
    left, right = a[np.cumsum(steps & 1) - 1], b[np.cumsum(steps >> 1) - 1]
    return left.astype(np.int64) << 32 | right


def link_counts(aligned: DataFrame, kind: np.dtype | None = None) -> DataFrame:
    """``pair, a_id, b_id, n, best``: how often each two ids are linked, and if no id of A is linked to ``b_id`` more often.

    Links are counted in each task before any row moves. The result is a written table.
    """
    kind = kind or id_kind()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held, size = [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            new, number = np.unique(np.concatenate(held), return_counts=True) if held else (pairs[:0], counts[:0])
            both, total = np.concatenate([pairs, new]), np.concatenate([counts, number])
            order = np.argsort(both, kind="stable")
            both, total = both[order], total[order]
            first = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.zeros(0, np.int64)
            return both[first], np.add.reduceat(total, first) if len(first) else total

        for batch in text_slices(batches, 0, IDS):
            (a, _), (b, _), (steps, _) = _sides(batch, 0, kind)
            held.append(_pairs(a, b, steps))
            size += len(steps)
            if size >= COUNTED:
                pairs, counts = merged()
                held, size = [], 0
                if len(pairs) >= COUNTED:
                    yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], ["pair", "n"])
                    pairs, counts = pairs[:0], counts[:0]
        pairs, counts = merged()
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], ["pair", "n"])

    counted = aligned.select("a_ids", "b_ids", "steps").mapInArrow(run, "pair long, n long")
    counted = materialise(counted.groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    b_id = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    counted = counted.select("pair", F.shiftright("pair", 32).cast("int").alias("a_id"), b_id.alias("b_id"), "n")
    # One row per id of B: bounded by its vocabulary.
    most = F.broadcast(counted.groupBy("b_id").agg(F.max("n").alias("most")))
    return materialise(counted.join(most, "b_id").select("pair", "a_id", "b_id", "n", (F.col("n") == F.col("most")).alias("best")), "links")


_DIGITS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _digits(most: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of the numbers up to ``most``, and which of them are written."""
    width = len(str(most))
    if width not in _DIGITS:
        numbers = np.arange(10**width)
        shown = np.stack([numbers // 10**k % 10 for k in range(width - 1, -1, -1)], axis=1).astype(np.uint8) + 48
        written = np.stack([(numbers >= 10**k) | (k == 0) for k in range(width - 1, -1, -1)], axis=1)
        _DIGITS[width] = shown, written
    return _DIGITS[width]


def _digests(a: np.ndarray, a_edges: np.ndarray, b: np.ndarray, b_edges: np.ndarray, steps: np.ndarray) -> list[str]:
    """SHA-256 of the groups of each document, as ``a1,a2|b1;a3|b2,b3``; empty without tokens."""
    group = np.cumsum(steps == 3) - 1
    of_a, of_b = group[(steps & 1) > 0], group[(steps >> 1) > 0]
    groups = int(group[-1]) + 1 if len(group) else 0
    before_a = np.concatenate([[0], np.cumsum(np.bincount(of_a, minlength=groups))])
    before_b = np.concatenate([[0], np.cumsum(np.bincount(of_b, minlength=groups))])
    at_a, at_b = np.arange(len(a)) + before_b[of_a], np.arange(len(b)) + before_a[of_b + 1]
    ids, mark = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.uint8)
    ids[at_a], ids[at_b] = a, b
    # What follows an id: another one of its side, the other side, another group, or the end of the document.
    mark[:] = ord(",")
    mark[at_a[before_a[1:] - 1]], mark[at_b[before_b[1:] - 1]] = ord("|"), ord(";")
    edges = a_edges + b_edges
    mark[edges[1:][np.diff(edges) > 0] - 1] = 0
    shown, written = _digits(int(ids.max(initial=0)))
    chars = np.concatenate([shown[ids], mark[:, None]], axis=1)
    taken = np.concatenate([written[ids], mark[:, None] > 0], axis=1)
    ends = np.concatenate([[0], np.cumsum(taken.sum(axis=1))])[edges].tolist()
    data = memoryview(chars[taken].tobytes())
    return [hashlib.sha256(data[x:y]).hexdigest() if y > x else "" for x, y in zip(ends[:-1], ends[1:], strict=True)]


def alignment_report(aligned: DataFrame, key: str = "doc_id", kind: np.dtype | None = None) -> DataFrame:
    """``key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of each aligned document.

    ``aligned`` is a written table (see ``align_tokens``). ``n_best`` counts the links that no other of
    their id of B outnumbers in the corpus, ``count_sum`` sums the counts of all links. A document
    without tokens has zeros and an empty digest.
    """
    kind = kind or id_kind()
    links = link_counts(aligned, kind)
    level = F.floor(F.log2("n") * FINE)
    sizes = links.groupBy(level.alias("level")).count().collect()  # at most 64 levels for each bit of a count
    lowest, total = 64 * FINE, 0
    for row in sorted(sizes, key=lambda row: -row["level"]):
        total += row["count"]
        if total > HOT:
            break
        lowest = row["level"]
    hot = links.filter(level >= lowest).select("pair", "n", "best").toArrow()
    keys, counts, best = (np.concatenate([chunk.to_numpy(zero_copy_only=False) for chunk in hot.column(k).chunks] or [np.zeros(0, np.int64)]) for k in range(3))
    best = best.astype(bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(keys)
        names = ["row", key, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "rare"]
        for batch in text_slices(batches, 2, IDS):
            (a, a_edges), (b, b_edges), (steps, edges) = _sides(batch, 2, kind)

            def per_document(values: np.ndarray, at: np.ndarray) -> pa.Array:
                return pa.array(np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[at]))

            pairs = _pairs(a, b, steps)
            found = lookup.find(pairs)
            known = found >= 0
            n = np.where(known, counts[found], 0) if len(counts) else np.zeros(len(found), np.int64)
            top = known & best[found] if len(counts) else known
            rare = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(~known)])[edges], pa.int32()), pa.array(pairs[~known])
            )
            columns = [
                batch.column(0), batch.column(1), pa.array(np.diff(a_edges)), pa.array(np.diff(b_edges)),
                per_document(steps == 3, edges), pa.array(np.diff(edges)), per_document(top, edges),
                per_document(n, edges), pa.array(_digests(a, a_edges, b, b_edges, steps)), rare,
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    numbered = aligned.select(F.monotonically_increasing_id().alias("row"), key, "a_ids", "b_ids", "steps")
    columns = f"row long, `{key}` {type_of(aligned, key)}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, rare array<long>"
    scored = materialise(numbered.mapInArrow(run, columns), "scored")
    # Links that no task knew meet their counts: each of them is rare, so none is a hot key.
    open_links = scored.select("row", F.explode("rare").alias("pair"))
    missing = open_links.join(links.filter(level < lowest).select("pair", "n", "best"), "pair")
    missing = missing.groupBy("row").agg(F.sum("n").alias("more_sum"), F.sum(F.col("best").cast("long")).alias("more_best"))
    joined = scored.join(missing, "row", "left")
    return joined.select(
        key, "n_a", "n_b", "n_groups", "n_links",
        (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"),
        "groups_sha256",
    )


def write_aligned(aligned: DataFrame) -> DataFrame:
    """The aligned documents as a table: every text is encoded once, whatever is counted afterwards."""
    path = new_dir(aligned.sparkSession, "aligned")
    aligned.write.option("compression", "zstd").parquet(path)
    return aligned.sparkSession.read.schema(aligned.schema).parquet(path)
