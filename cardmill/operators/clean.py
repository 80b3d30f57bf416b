"""From extracted rows to output rows: trim, drop blanks and repeats, append."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import strip
from ..session import materialise
from .joins import lookup


def quoted(names: Sequence[str]) -> list[str]:
    return [f"`{name}`" for name in names]


def _filled(fields: Sequence[str]) -> Column:
    return F.concat(*map(F.col, quoted(fields))) != ""


def clean_records(df: DataFrame, fields: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Declared columns in order, trimmed, missing ones empty; blank rows go."""

    def value(name: str) -> Column:
        if name not in df.columns:
            return F.lit("").alias(name)
        return strip(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))).alias(name)

    return df.select(*quoted(keep), *map(value, fields)).filter(_filled(fields))


def distinct_records(df: DataFrame, fields: Sequence[str], first: Sequence[str] = ()) -> DataFrame:
    """One row per distinct output row.

    Repeats are merged before the shuffle, however many there are. ``first``
    names columns telling where a row came from: the smallest is kept.
    """
    names = quoted(fields)
    if not first:
        return df.select(*names).dropDuplicates()
    origin = F.min(F.struct(*quoted(first))).alias("__first")
    return df.groupBy(*names).agg(origin).select("__first.*", *names)


def new_records(df: DataFrame, existing: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Distinct rows of ``df`` that ``existing`` lacks.

    Both sides are reduced to distinct rows before the one shuffle, so a row
    repeated a billion times costs one row per task.
    """
    names = quoted(fields)
    fresh = df.select(*names, F.lit(True).alias("__fresh"))
    known = existing.select(*names, F.lit(False).alias("__fresh"))
    both = fresh.unionByName(known).groupBy(*names).agg(F.min("__fresh").alias("__fresh"))
    return both.filter("__fresh").select(*names)


def duplicate_counts(
    df: DataFrame, fields: Sequence[str], by: Sequence[str] = (), existing: DataFrame | None = None
) -> DataFrame:
    """How many rows writing would drop, per ``by``.

    That is all but one of equal rows; all of them if ``existing``, the target
    of an append, already has the row. Equal rows are merged before any shuffle, so a
    row in every crawl is a row per crawl and task; known rows that are most frequent are
    broadcast to them, the others are shuffled (``joins.lookup``).
    """
    names, groups = quoted(fields), quoted(by)
    marked = df.select(*(F.col(name).alias(f"__by{k}") for k, name in enumerate(groups)), *names, F.lit(1).alias("__copies"))
    keys = [f"__by{k}" for k in range(len(groups))]
    counts = marked.groupBy(*keys, *names).agg(F.sum("__copies").alias("__copies"))
    if existing is not None:
        # Which rows are known is found between distinct rows; a row in every crawl is then a hot key of the look-up.
        row = F.to_json(F.struct(*(F.col(name).alias(f"f{k}") for k, name in enumerate(names)))).alias("__row")
        counts = materialise(counts.select(*keys, "__copies", row), "counts")
        known = counts.select("__row").distinct().join(existing.select(row).distinct(), "__row", "left_semi")
        known = materialise(known.withColumn("__known", F.lit(1)), "known")
        counts = lookup(counts, known, "__row", written=True)
        counts = counts.withColumn("__copies", F.col("__copies") + F.coalesce("__known", F.lit(0)))
    sums = counts.groupBy(*keys).agg(F.coalesce(F.sum(F.col("__copies") - 1), F.lit(0)).alias("duplicates"))
    return sums.select(*(F.col(key).alias(name) for key, name in zip(keys, by, strict=True)), "duplicates")
