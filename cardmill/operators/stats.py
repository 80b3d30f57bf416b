"""Run statistics of crawls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .clean import clean_records, duplicate_counts
from .crawl import crawl_records

REPORTED_ERRORS = 10


def finish_reason(last: Column) -> Column:
    """Why a walk ended, told by its last visit."""
    return (
        F.when(~last["ok"] & last["stop_on_error"], "error")
        .when(last["ok"] & (last["found"] == 0), "no_items")
        .when(last["ok"] & (last["kept"] == 0), "empty_rows")
        .when(last["n"] >= last["max_pages"], "max_pages")
        .otherwise("no_next")
    )


def crawl_errors(visited: DataFrame) -> DataFrame:
    """Every error with the visit it happened at."""
    return visited.filter(F.col("error").isNotNull()).select("crawl_id", "n", "url", "error")


def first_errors(visited: DataFrame, limit: int = REPORTED_ERRORS) -> DataFrame:
    """The messages a report shows, in visit order.

    The rank filter runs before the shuffle as well: at most ``limit`` rows per
    crawl and task are moved.
    """
    place = F.row_number().over(Window.partitionBy("crawl_id").orderBy("n"))
    top = crawl_errors(visited).withColumn("place", place).filter(F.col("place") <= limit)
    listed = F.array_sort(F.collect_list(F.struct("n", "error")))
    return top.groupBy("crawl_id").agg(F.transform(listed, lambda e: e["error"]).alias("first_errors"))


def crawl_stats(
    visited: DataFrame, fields: Sequence[str], deduplicate: bool = True, existing: DataFrame | None = None,
    reported: int = REPORTED_ERRORS,
) -> DataFrame:
    """One row per crawl: counters, error messages and the finish reason.

    ``existing`` is what the target of an append holds before the run; ``reported`` is
    how many messages a report shows. The visits are written once and read three times.
    """
    visited = materialise(visited, "visits")
    last = F.max_by(F.struct("n", "ok", "found", "kept", "max_pages", "stop_on_error"), "n")
    totals = visited.groupBy("crawl_id").agg(
        F.count("*").alias("pages"),
        F.sum("found").alias("containers"),
        F.sum("kept").alias("rows"),
        F.sum("skipped").alias("skipped"),
        F.sum("requests").alias("requests"),
        F.count("error").alias("errors"),
        last.alias("last"),
    )
    stats = totals.withColumn("finish_reason", finish_reason(F.col("last"))).drop("last")
    stats = stats.join(first_errors(visited, reported), "crawl_id", "left")
    if deduplicate:
        crawl_id = "source_crawl_id" if "crawl_id" in fields else "crawl_id"
        rows = clean_records(crawl_records(visited, fields), fields, keep=[crawl_id])
        repeats = duplicate_counts(rows, fields, [crawl_id], existing).withColumnRenamed(crawl_id, "crawl_id")
        stats = stats.join(repeats, "crawl_id", "left")
    else:
        stats = stats.withColumn("duplicates", F.lit(0).cast("long"))
    return stats.select(
        "crawl_id", "pages", "containers", "rows", "skipped",
        F.coalesce("duplicates", F.lit(0).cast("long")).alias("duplicates"),
        "requests", "errors",
        F.coalesce("first_errors", F.array().cast("array<string>")).alias("first_errors"),
        "finish_reason",
    )
