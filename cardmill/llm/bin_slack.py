"""Packing of documents into sequences by minimum bin slack (operator 11).

How sequences are filled depends on how many pieces of each length there are, and on
nothing else: at most ``capacity`` numbers. The plan is made from them. A sequence starts
with the longest piece left; a dynamic programme over bit sets (bit t: some choice of
pieces has t tokens) finds the fullest choice for the room behind it, and the choice is
taken off as often as there are pieces for it. Every step uses up a length, so a plan has
a few thousand steps at any size of the corpus. Spark numbers the pieces of each length
and looks their places up in the plan; ids lie where they were written.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialise
from .huffman_ids import library_ids

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
CAPACITY, END = 2048, 0
#: Pieces of one length that one task numbers.
BUCKET = 100_000

PIECES = "row long, doc_id long, piece int, start long, length int, ids binary"


def cut_pieces(docs: DataFrame, capacity: int = CAPACITY, path: str = TOKENIZER, end: int = END) -> DataFrame:
    """``row, doc_id, piece, start, length, ids``: a written table of the pieces of all documents.

    Ids are those of the tokenizers library with ``end`` behind them, 4 bytes each, little-endian;
    a null or empty text has the end id alone. A document above ``capacity`` ids is cut so that
    all pieces but the first are full. Rows that repeat a ``doc_id``, or lack one, are documents
    of their own; other columns are ignored, whatever their names. ``row`` numbers the pieces.
    """
    encoded = library_ids(docs, path, end, added=True)
    count = F.floor((F.col("n_tokens") - 1) / capacity).cast("int")
    first = F.col("n_tokens") - count * capacity

    def piece(k):
        start = F.when(k == 0, F.lit(0).cast("long")).otherwise(first + (k - 1) * capacity)
        length = F.when(k == 0, first).otherwise(F.lit(capacity))
        data = F.substring("ids", (start * 4 + 1).cast("int"), (length * 4).cast("int"))
        return F.struct(k.alias("piece"), start.alias("start"), length.cast("int").alias("length"), data.alias("ids"))

    pieces = encoded.select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), count), piece)).alias("p"))
    return materialise(pieces.select(F.monotonically_increasing_id().alias("row"), "doc_id", "p.*"), "pieces")


def fullest(counts: dict[int, int], room: int, slack: int = 0) -> dict[int, int]:
    """The choice of pieces with the most tokens in ``room``: how many of each length.

    Of several that are as full, the one whose shortest lengths are used least. Lengths come
    in, longest first, until a choice leaves no more than ``slack``.
    """
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((length for length in counts if length <= room), reverse=True):
        steps.append((length, reach))
        # All numbers of copies up to the limit, in doubling steps.
        left, step = min(counts[length], room // length), 1
        while left:
            step = min(step, left)
            reach |= reach << (length * step) & mask
            left, step = left - step, step * 2
        if reach >> max(room - slack, 0):
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        while not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + 1
            total -= length
    return chosen


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """``(copies, {length: pieces})`` of all sequences, in the order in which they are filled.

    Short pieces spent on filling sequences to the brim may be missing for long ones later: if
    the plan needs more sequences than all tokens do, plans that allow some slack are tried too.
    """
    fewest = -(-sum(length * n for length, n in counts.items()) // capacity)
    best: list[tuple[int, dict[int, int]]] | None = None
    for slack in (0, *(capacity >> k for k in (9, 7, 5, 3, 1))):
        steps = _plan(counts, capacity, slack)
        if best is None or sum(copies for copies, _ in steps) < sum(copies for copies, _ in best):
            best = steps
        if sum(copies for copies, _ in best) <= fewest:
            break
    return best or []


def _plan(counts: dict[int, int], capacity: int, slack: int) -> list[tuple[int, dict[int, int]]]:
    left, steps = {length: n for length, n in counts.items() if n}, []
    while left:
        longest = max(left)
        rest = {length: n - (length == longest) for length, n in left.items() if n > (length == longest)}
        chosen = fullest(rest, capacity - longest, slack)
        chosen[longest] = chosen.get(longest, 0) + 1
        copies = min(left[length] // n for length, n in chosen.items())
        for length, n in chosen.items():
            left[length] -= copies * n
            if not left[length]:
                del left[length]
        steps.append((copies, chosen))
    return steps


def _places(spark: SparkSession, steps: list[tuple[int, dict[int, int]]]) -> DataFrame:
    """For ranks ``low`` to ``high`` of a length: the first of ``copies`` sequences, and the place there."""
    rows, used, sequence = [], {}, 0
    for copies, chosen in steps:
        offset = 0
        for length in sorted(chosen, reverse=True):
            low = used.get(length, 0)
            used[length] = low + copies * chosen[length]
            rows.append((length, low, used[length], sequence, copies, offset))
            offset += length * chosen[length]
        sequence += copies
    return spark.createDataFrame(rows, "length int, low long, high long, sequence long, copies long, place long")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``row, sequence_id, offset`` of every piece: sequences of at most ``capacity`` tokens, filled without gaps.

    ``pieces`` is a written table with ``row`` and ``length`` (1 to ``capacity``). Only these two
    columns move. Pieces of one length are numbered in buckets, so a length that a third of
    all pieces have is many tasks' work. No pieces make no rows.
    """
    spark = pieces.sparkSession
    sizes = materialise(pieces.groupBy("length").agg(F.count("*").alias("n")), "lengths")
    counts = {row["length"]: row["n"] for row in sizes.collect()}  # one row per length, capacity at most
    if not counts:
        return pieces.select("row", F.col("row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    buckets = F.broadcast(sizes.select("length", F.ceil(F.col("n") / BUCKET).alias("buckets")))
    dealt = pieces.select("row", "length").join(buckets, "length")
    dealt = dealt.select("row", "length", F.pmod(F.xxhash64("row"), F.col("buckets")).alias("bucket"))
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    starts = starts.select("length", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row"))
    ranked = dealt.withColumn("inside", inside).join(starts, ["length", "bucket"])
    ranked = ranked.select("row", "length", (F.col("before") + F.col("inside") - 1).alias("rank"))
    # Bounded by the capacity: a few thousand steps of at most 63 different lengths.
    places = F.broadcast(_places(spark, plan(counts, capacity)))
    fits = (ranked["length"] == places["length"]) & (ranked["rank"] >= places["low"]) & (ranked["rank"] < places["high"])
    at = F.col("rank") - F.col("low")
    return ranked.join(places, fits).select(
        "row",
        (F.col("sequence") + at % F.col("copies")).alias("sequence_id"),
        (F.col("place") + F.floor(at / F.col("copies")) * ranked["length"]).alias("offset"),
    )


def sequences(pieces: DataFrame, places: DataFrame) -> DataFrame:
    """``sequence_id, length, ids``: the packed ids themselves, 4 bytes each; a group is one sequence."""
    own = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = places.join(pieces.select("row", "length", "ids"), "row").groupBy("sequence_id")
    packed = joined.agg(F.sum("length").alias("length"), own.alias("parts"))
    data = F.unhex(F.array_join(F.transform("parts", lambda part: F.hex(part["ids"])), ""))
    return packed.select("sequence_id", "length", data.alias("ids"))
