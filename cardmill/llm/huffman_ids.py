"""Token ids in files of canonical, length-limited Huffman codes (operator 9).

A folder holds a codebook, one row with the code length of every id, and blocks, rows
of whole documents in ascending order. A block stands alone: it lists its documents and
their numbers of tokens, and the bit offset of every 128th token within its document,
so that any part is decoded without what lies before it. Decoding looks up as many bits
as the longest code has in a table and runs through all stretches between checkpoints
side by side.

Texts are encoded where they lie and never move: ids are written once, counted, coded,
and only the codes are sorted by document. Files are written and read by Spark, so lost
tasks are simply done again and nothing lies outside the shared folders.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.joins import fits_broadcast
from ..session import materialise, new_dir
from .arrow import flat_bytes, lists, ragged, raw_texts, slices, text_slices, texts
from .chunks import byte_bpe

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END = 2
#: The longest code; longer if there are too many ids for it.
LIMIT = 18
#: Tokens between two checkpoints, and bytes after which a block is closed.
STEP = 128
BLOCK_BYTES = 1 << 18
BATCH = 512
#: Tokens of a range of documents that one task sorts.
RANGE = 1 << 20
#: Bytes of codes that are decoded at once.
DECODED = 1 << 21


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Code lengths of least total size, none above ``limit``, 0 for ids that never occur (package-merge)."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    limit = max(limit, int(len(used) - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    row, kinds = leaves, [np.ones(len(leaves), bool)]
    for _ in range(limit - 1):
        packages = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, packages])
        place = np.argsort(both, kind="stable")
        row = both[place]
        kinds.append(place < len(leaves))
    taken = 2 * len(leaves) - 2
    depth = np.zeros(len(leaves), np.int64)
    for kind in reversed(kinds):
        own = int(kind[:taken].sum())
        depth[:own] += 1
        taken = 2 * (taken - own)
    lengths[order] = depth
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    codes = np.zeros(len(lengths), np.uint64)
    code, before = 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    for symbol in order[lengths[order] > 0].tolist():
        code <<= int(lengths[symbol]) - before
        before = int(lengths[symbol])
        codes[symbol] = code
        code += 1
    return codes


class Codec:
    def __init__(self, lengths: np.ndarray):
        self.lengths, self.codes = lengths.astype(np.int64), canonical(lengths)
        self.width = int(lengths.max(initial=1))
        self.symbols = np.zeros(1 << self.width, np.uint32)
        self.sizes = np.ones(1 << self.width, np.uint8)
        for symbol in np.flatnonzero(lengths):
            size = int(lengths[symbol])
            low = int(self.codes[symbol]) << (self.width - size)
            self.symbols[low : low + (1 << (self.width - size))] = symbol
            self.sizes[low : low + (1 << (self.width - size))] = size

    def encode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], list[np.ndarray]]:
        """Codes of each document, from a byte on, and the bit offset of its every 128th token."""
        sizes = self.lengths[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        bytes_each = -(-np.diff(ends[offsets]) // 8)
        starts = np.concatenate([[0], np.cumsum(bytes_each)])
        counts = np.diff(offsets)
        inside = ends[:-1] - np.repeat(ends[offsets[:-1]], counts)
        places = inside + np.repeat(starts[:-1] * 8, counts)
        words = np.zeros(int(starts[-1]) // 4 + 3, np.uint64)
        if len(ids):
            word = places >> 5
            value = self.codes[ids] << (64 - (places & 31) - sizes).astype(np.uint64)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            # Codes do not overlap, so sums are unions of bits.
            words[word[first]] += np.add.reduceat(value >> np.uint64(32), first)
            words[word[first] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
        data = words.astype(">u4").tobytes()
        checks = [inside[a + STEP : b : STEP] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return [data[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)], checks

    def decode(self, data: bytes, bits: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Ids of all stretches, one after the other: where each starts and how many tokens it has."""
        out = np.empty(int(counts.sum()), np.uint32)
        raw = np.frombuffer(data + bytes(8), np.uint8).astype(np.uint32)
        window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        order = np.argsort(-counts, kind="stable")
        at, left = bits[order].copy(), counts[order]
        to = (np.cumsum(counts) - counts)[order]
        shift, mask = 32 - self.width, (1 << self.width) - 1
        going = len(at)
        for step in range(int(left.max(initial=0))):
            # The stretches that still go on come first.
            while left[going - 1] <= step:
                going -= 1
            here = at[:going]
            found = (window[here >> 3] >> (shift - (here & 7)).astype(np.uint32)) & np.uint32(mask)
            out[to[:going] + step] = self.symbols[found]
            here += self.sizes[found]
        return out


_LIBRARY: dict[str, tuple] = {}


def _library(path: str) -> tuple:
    """The library's tokenizer and the contents of its added tokens, one per Python worker."""
    if path not in _LIBRARY:
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        _LIBRARY[path] = whole, [token.content for token in whole.get_added_tokens_decoder().values()]
    return _LIBRARY[path]


def _rows_with(flat: np.ndarray, edges: np.ndarray, contents: list[str]) -> list[int]:
    """The texts that hold one of some strings."""
    data, rows = flat.tobytes(), set()
    for content in map(str.encode, contents):
        at = data.find(content)
        while at >= 0:
            row = int(np.searchsorted(edges, at, "right")) - 1
            if at + len(content) <= edges[row + 1]:
                rows.add(row)
            at = data.find(content, at + 1)
    return sorted(rows)


def library_ids(
    docs: DataFrame, path: str = TOKENIZER, end: int = END, pattern: str = public_tokenizers.PATTERN, added: bool = False
) -> DataFrame:
    """``doc_id, n_tokens, ids``: the ids of every whole text and the end id, 4 bytes each, little-endian.

    ``path`` is a byte-level BPE of the tokenizers library that cuts texts by ``pattern``
    and has no normaliser. With ``added``, its added tokens in texts have their own ids, as
    in the library's default settings; else they are ordinary text (``encode_special_tokens``).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = byte_bpe(path, pattern)
        library, contents = _library(path) if added else (None, [])
        for batch in text_slices(batches, 1):
            flat, edges = flat_bytes(batch.column(1))
            # Texts with an added token are left to the library as they are.
            special = _rows_with(flat, edges, contents)
            found = [np.array(library.encode(text, add_special_tokens=False).ids, np.uint32) for text in texts(batch.column(1).take(pa.array(special, pa.int64())))]
            if special:
                blank = np.zeros(len(flat), bool)
                blank[ragged(edges[special], np.diff(edges)[special])] = True
                edges = edges - np.concatenate([[0], np.cumsum(blank)])[edges]
                flat = flat[~blank]
            ids, offsets = pool.encode_all(flat, edges)
            counts = np.diff(offsets)
            if special:
                counts[special] = [len(one) for one in found]
                ids = np.insert(ids, np.repeat(offsets[special], counts[special]), np.concatenate(found))
            # One more place for each text, with the end id.
            out = np.full(len(ids) + len(counts), end, "<u4")
            edges = np.concatenate([[0], np.cumsum(counts + 1)])
            out[ragged(edges[:-1], counts)] = ids
            data = [out[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
            columns = [batch.column(0).cast(pa.int64()), pa.array(counts + 1), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(
        run, "doc_id long, n_tokens long, ids binary"
    )


def id_counts(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs, over all documents; one row per id reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in slices(batches, BATCH):
            own = np.bincount(np.frombuffer(b"".join(raw_texts(batch.column(0))), "<u4"))
            if len(own) > len(total):
                total = np.concatenate([total, np.zeros(len(own) - len(total), np.int64)])
            total[: len(own)] += own
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    rows = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((row["id"] for row in rows), default=0) + 1, np.int64)
    for row in rows:
        counts[row["id"]] = row["n"]
    return counts


def _ranges(tokens: DataFrame, parts: int) -> tuple[Column, int]:
    """The range of ``doc_id`` that a row belongs to, and how many there are: one for ``RANGE`` tokens, if tasks allow."""
    total = tokens.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    parts = max(min(parts, total // RANGE), total // (RANGE << 6), 1)
    shares = [(k + 1) / parts for k in range(parts - 1)]
    bounds = tokens.agg(F.percentile_approx("doc_id", shares, 100 * parts)).first()[0] if shares else None
    if not bounds:
        return F.lit(0), 1
    bounds = F.array(*map(F.lit, sorted(set(bounds))))
    return F.coalesce(F.size(F.filter(bounds, lambda bound: bound < F.col("doc_id"))), F.lit(0)), parts


def write_ids(tokens: DataFrame, path: str, limit: int = LIMIT) -> None:
    """Write ``doc_id, n_tokens, ids`` (as of ``library_ids``) to a folder, in ascending ``doc_id`` order.

    Rows without an id come first; rows that repeat an id follow each other in order of
    their codes. A document lies in one block, however long. No rows make an empty folder
    with an empty codebook.
    """
    spark = tokens.sparkSession
    stored = new_dir(spark, "ids")
    tokens.write.option("compression", "zstd").parquet(stored)
    tokens = spark.read.schema(tokens.schema).parquet(stored)
    lengths = code_lengths(id_counts(tokens), limit)
    book = spark.createDataFrame([(bytes(lengths),)], "lengths binary")
    book.coalesce(1).write.parquet(f"{path}/codebook")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(lengths)
        for batch in slices(batches, BATCH):
            sizes = np.array(batch.column(1))
            ids = np.frombuffer(b"".join(raw_texts(batch.column(2))), "<u4")
            data, checks = codec.encode(ids, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))
            ends = np.concatenate([[0], np.cumsum([len(c) for c in checks])])
            flat = np.concatenate(checks).astype(np.int64) if checks else np.zeros(0, np.int64)
            columns = [batch.column(0), batch.column(1), pa.array(data, pa.binary()), lists(flat, ends)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "code", "checks"])

    coded = tokens.mapInArrow(code, "doc_id long, n_tokens long, code binary, checks array<long>")
    order = ["doc_id", "n_tokens", "code"]
    # Bounds come from the written ids: a range exchange would code everything once more to sample it.
    part, parts = _ranges(tokens, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = coded.select("*", part.alias("part")).repartitionById(parts, "part").sortWithinPartitions("part", *order)

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "block", "doc_ids", "tokens", "sizes", "code", "checks"]
        number, held, size = 0, [], 0

        def closed() -> pa.RecordBatch:
            ids, tokens, codes, checks, part = zip(*held, strict=True)
            columns = [
                pa.array([part[0]], pa.int32()), pa.array([number], pa.int32()), pa.array([ids], pa.list_(pa.int64())),
                pa.array([tokens], pa.list_(pa.int64())), pa.array([[len(c) for c in codes]], pa.list_(pa.int64())),
                pa.array([b"".join(codes)], pa.binary()),
                pa.array([[c for own in checks for c in own]], pa.list_(pa.int64())),
            ]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if held and held[-1][-1] != row[-1]:
                    yield closed()
                    number, held, size = number + 1, [], 0
                held.append(row)
                size += len(row[2])
                if size >= BLOCK_BYTES:
                    yield closed()
                    number, held, size = number + 1, [], 0
        if held:
            yield closed()

    blocks = ranged.select("doc_id", "n_tokens", "code", "checks", "part").mapInArrow(
        block,
        "part int, block int, doc_ids array<long>, tokens array<long>, sizes array<long>, code binary, checks array<long>",
    )
    # Codes are as dense as they get: compressing them again would only cost time.
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of a written folder; ``start`` counts the ids of all documents before."""
    lengths = np.frombuffer(spark.read.parquet(f"{path}/codebook").first()["lengths"], np.uint8)
    blocks = spark.read.parquet(f"{path}/blocks")
    # Where each block starts: within its part of the sort, and the parts one after the other.
    sums = blocks.select("part", "block", F.aggregate("tokens", F.lit(0).cast("long"), lambda a, b: a + b).alias("sum"))
    sums = materialise(sums, "block-sums")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sums.groupBy("part").agg(F.sum("sum").alias("sum"))
    parts = parts.select("part", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("part", "block", F.coalesce(F.sum("sum").over(inside), F.lit(0)).alias("inside"))
    starts = starts.join(parts, "part").select("part", "block", (F.col("before") + F.col("inside")).alias("start"))
    starts = materialise(starts, "block-starts")
    placed = blocks.join(F.broadcast(starts) if fits_broadcast(starts) else starts, ["part", "block"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(lengths)
        for batch in slices(batches, DECODED // BLOCK_BYTES):
            tokens = np.array(batch.column("tokens").flatten())
            sizes = np.array(batch.column("sizes").flatten())
            checks = np.array(batch.column("checks").flatten())
            starts = (np.cumsum(sizes) - sizes) * 8
            # A document starts a stretch of its own, and so does every checkpoint.
            stretches = np.maximum(-(-tokens // STEP), 1)
            first = np.cumsum(stretches) - stretches
            bits = np.repeat(starts, stretches)
            later = np.ones(len(bits), bool)
            later[first] = False
            bits[later] += checks
            counts = np.full(len(bits), STEP)
            counts[first + stretches - 1] = tokens - (stretches - 1) * STEP
            ids = codec.decode(b"".join(raw_texts(batch.column("code"))), bits, counts)
            edges = np.concatenate([[0], np.cumsum(tokens)])
            data = [ids[a:b].astype("<u4").tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
            each = batch.column("tokens").value_lengths().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(each)])
            block_start = np.array(batch.column("start")) - edges[ends[:-1]]
            begin = edges[:-1] + np.repeat(block_start, each)
            columns = [batch.column("doc_ids").flatten(), pa.array(begin), pa.array(tokens), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids"])

    columns = ["start", "doc_ids", "tokens", "sizes", "code", "checks"]
    return placed.select(*columns).mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")
