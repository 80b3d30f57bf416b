"""Pages arriving as files, records leaving as CSV."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.clean import clean_records, distinct_records, quoted
from ..operators.extract import page_facts, parse_pages, records
from ..operators.rules import PageRules
from ..sources.csv_output import MARKED_ENCODING, csv_options, with_bom
from ..sources.pages import PAGES


def page_stream(spark: SparkSession, folder: str, glob: str = "*.parquet", files_per_batch: int = 100) -> DataFrame:
    """Page files in the order they appear."""
    reader = spark.readStream.schema(PAGES).option("pathGlobFilter", glob)
    return reader.option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def table_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A stored page table as a stream, be it one file or a folder of files."""
    # Spark takes a path without a pattern for a folder; a pattern may stand for either.
    reader = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def stream_records(pages: DataFrame, rules: PageRules, deduplicate: bool = True) -> DataFrame:
    """Clean records of a page stream.

    Dropping repeats keeps one state row per distinct record for good, as the
    output must never repeat; the state is partitioned over the cluster and
    kept on disk by the RocksDB store of ``build_session``.
    """
    rows = clean_records(records(parse_pages(pages, rules), rules), rules.names)
    return rows.dropDuplicates(rules.names) if deduplicate else rows


def unwritten_records(rows: DataFrame, existing: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Rows of a record stream that ``existing``, the target of an append, lacks.

    ``existing`` is read once, when the stream starts; what the stream itself writes
    later is in the state of ``stream_records``. Each batch meets the distinct rows of
    the target in an anti-join.
    """
    known = distinct_records(existing, fields).select(F.struct(*quoted(fields)).alias("__row"))
    own = rows.select(F.struct(*quoted(fields)).alias("__row"))
    return own.join(known, "__row", "left_anti").select("__row.*")


def recent_records(pages: DataFrame, rules: PageRules, time: str, delay: str) -> DataFrame:
    """Weaker, with bounded state: repeats are dropped within ``delay`` of each other."""
    keep = ("page_id", "url", time)
    rows = records(parse_pages(pages, rules, keep=keep), rules, keep=keep)
    rows = clean_records(rows, rules.names, keep=[time])
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(rules.names).select(*rules.names)


def write_stream(
    rows: DataFrame, path: str, checkpoint: str, encoding: str = MARKED_ENCODING, once: bool = True
) -> StreamingQuery:
    """Append each batch to the CSV folder exactly once; finished parts can be read meanwhile."""
    writer = with_bom(rows, encoding).writeStream.format("csv").outputMode("append").options(**csv_options(encoding))
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start(path)


def observe_pages(
    pages: DataFrame, rules: PageRules, on_pages: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True
) -> StreamingQuery:
    """Hand every batch's pages (``page_facts``) to ``on_pages``."""
    facts = page_facts(parse_pages(pages, rules), rules)
    writer = facts.writeStream.foreachBatch(on_pages).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
