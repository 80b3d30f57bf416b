"""Token counts of documents in flat token files, by scanning for separators (operator 2).

A flat file is nothing but ids of a fixed width, documents one after the other, each
with an end-of-document id behind it; no index says where. Files are read in blocks of
a fixed size. A task looks through its blocks with one vectorised comparison each and
keeps where the separators are. A prefix scan over the blocks (sums of tokens and of
separators, the largest separator so far), first within each file, then over the files,
tells every block how many tokens and documents lie before it and where the document
began that runs into it. Documents may run over any number of blocks and files.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialise
from .arrow import flat_bytes, slices, text_slices
from .bitmap_bpe import RANKS, _pool

#: Ids of 16 bits, the high byte first.
KIND = ">u2"
#: An id that the vocabulary leaves free. Its two bytes are one UTF-8 character, which Spark's writer puts between documents.
END = 0xC480
BLOCK_BYTES = 1 << 20
#: Documents and bytes of a written file, at most: Spark reads such a file whole before it is cut into blocks.
FILE_DOCS, FILE_BYTES = 4000, 1 << 30


def write_flat(
    docs: DataFrame, path: str, ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN, end: int = END
) -> None:
    """Token ids of every whole text (``text``; null is empty) as flat files, in the order of the rows.

    Spark's text writer puts the separator behind each document, so a lost task leaves
    no half-written file. The vocabulary must fit 16 bits and leave ``end`` free.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = _pool(ranks, pattern)
        for batch in text_slices(batches, 0):
            ids, offsets = pool.encode_all(*flat_bytes(batch.column(0)))
            flat = ids.astype(KIND)
            data = [flat[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(data, pa.binary())], ["ids"])

    separator = np.array([end], KIND).tobytes().decode()
    # A token has a byte of text at least, so a document takes twice its text's bytes at most.
    longest = docs.agg(F.coalesce(F.max(F.octet_length("text")), F.lit(0)).cast("long")).first()[0]
    each = max(min(FILE_DOCS, FILE_BYTES // (2 * longest + 2)), 1)
    rows = docs.select("text").mapInArrow(encode, "ids binary").select(F.col("ids").cast("string").alias("value"))
    rows.write.option("lineSep", separator).option("maxRecordsPerFile", each).text(path)


def token_blocks(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``file, block, data``: the files of a folder, cut into blocks. A file may have up to 2 GB, as Spark reads it.

    ``write_flat`` keeps files below ``FILE_BYTES``, but for a single document that has more.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    size = F.lit(block_bytes)
    last = F.greatest(F.ceil(F.col("length") / size) - 1, F.lit(0))
    cut = F.transform(F.sequence(F.lit(0), last.cast("int")), lambda k: F.substring(F.col("content"), k * size + 1, size))
    return files.select(F.col("path").alias("file"), F.posexplode(cut).alias("block", "data"))


def scan_separators(blocks: DataFrame, end: int = END, kind: str = KIND) -> DataFrame:
    """``doc_no, start, n_tokens, ended`` of every document in ``blocks`` (``file, block, data``).

    Files follow each other by name, blocks by number. ``start`` counts tokens from the
    first file on, separators included; ``n_tokens`` leaves the separator out. Tokens
    behind the last separator are a document that has not ``ended``. Two separators in
    a row hold an empty document; no data, or none at all, holds no document. Blocks must
    hold whole ids.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 16):
            found = [np.frombuffer(data or b"", kind) for data in batch.column(2).to_pylist()]
            ends = [np.flatnonzero(ids == end) for ids in found]
            columns = [*batch.columns[:2], pa.array([len(ids) for ids in found], pa.int64()), pa.array(ends, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["file", "block", "tokens", "ends"])

    found = blocks.select("file", F.col("block").cast("int").alias("block"), "data")
    found = materialise(found.mapInArrow(scan, "file string, block int, tokens long, ends array<long>"), "separators")
    sums = found.select("file", "block", "tokens", F.size("ends").cast("long").alias("docs"), F.try_element_at("ends", F.lit(-1)).alias("last"))
    inside = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    within = sums.select(
        "file", "block", "tokens", "docs", "last",
        F.coalesce(F.sum("tokens").over(inside), zero).alias("tokens_before"),
        F.coalesce(F.sum("docs").over(inside), zero).alias("docs_before"),
    )
    # The end of the last document before a block, counted within its file; null if there is none.
    within = within.withColumn("opened", F.max(F.col("tokens_before") + F.col("last") + 1).over(inside))
    within = materialise(within, "within-files")
    files = within.groupBy("file").agg(
        F.sum("tokens").alias("tokens"), F.sum("docs").alias("docs"),
        F.max(F.col("tokens_before") + F.col("last") + 1).alias("opened"),
    )
    # One row per file is all that is sorted as a whole.
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select(
        "file", "tokens", "docs", "opened",
        F.coalesce(F.sum("tokens").over(earlier), zero).alias("file_tokens"),
        F.coalesce(F.sum("docs").over(earlier), zero).alias("file_docs"),
    )
    files = files.withColumn("file_opened", F.coalesce(F.max(F.col("file_tokens") + F.col("opened")).over(earlier), zero))
    files = materialise(files, "files")
    placed = within.select("file", "block", "tokens_before", "docs_before", "opened").join(
        files.select("file", "file_tokens", "file_docs", "file_opened"), "file"
    )
    placed = placed.select(
        "file", "block", (F.col("file_tokens") + F.col("tokens_before")).alias("base"),
        (F.col("file_docs") + F.col("docs_before")).alias("docs"),
        F.coalesce(F.col("file_tokens") + F.col("opened"), "file_opened").alias("opened"),
    )
    joined = found.filter(F.size("ends") > 0).join(placed, ["file", "block"])
    rows = joined.select("base", "docs", "opened", "ends", F.posexplode("ends").alias("place", "end"))
    start = F.when(F.col("place") == 0, F.col("opened")).otherwise(
        F.col("base") + F.try_element_at("ends", F.greatest("place", F.lit(1))) + 1
    )
    ended = rows.select(
        (F.col("docs") + F.col("place")).alias("doc_no"), start.alias("start"),
        (F.col("base") + F.col("end") - start).alias("n_tokens"), F.lit(True).alias("ended"),
    )
    total = files.agg(
        F.sum("docs").alias("doc_no"), F.coalesce(F.max(F.col("file_tokens") + F.col("opened")), zero).alias("start"),
        F.sum("tokens").alias("tokens"),
    )
    rest = total.filter(F.col("tokens") > F.col("start"))
    return ended.unionByName(rest.select("doc_no", "start", (F.col("tokens") - F.col("start")).alias("n_tokens"), F.lit(False).alias("ended")))
