"""Joins that pick broadcast or shuffle by a measured size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .sieve import bit_map, marked

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
SMALL_ROWS = 1_000_000
HOT_SHARE = 1 / 64
SIEVE = "__may_be_key"


def fits_broadcast(table: DataFrame) -> bool:
    """Measured rows and text bytes of a written table."""
    return table.count() <= BROADCAST_ROWS and _bytes(table) <= BROADCAST_BYTES


def _bytes(table: DataFrame) -> int:
    size = sum((F.length(F.to_json(F.struct(f"`{name}`"))) for name in table.columns), F.lit(0))
    return table.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]


def drop_keys(df: DataFrame, keys: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows of ``df`` whose key is not among ``keys``; few keys are broadcast.

    The keys are written down first: they are read twice, to be measured and joined. Of
    more keys every task gets a bit map; rows that miss it stay where they are, and
    only the others, which are hits but for a few, are shuffled to the keys.
    """
    keys = materialise(keys, "keys")
    if fits_broadcast(keys):
        return df.join(F.broadcast(keys), key, "left_anti")
    flagged = _sifted(df, keys, key)
    missed = flagged.filter(f"not {SIEVE}").drop(SIEVE)
    return missed.unionByName(flagged.filter(SIEVE).drop(SIEVE).join(keys, key, "left_anti"))


def keep_keys(df: DataFrame, keys: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows of ``df`` whose key is among ``keys``, a written table; other rows are not moved."""
    if fits_broadcast(keys):
        return df.join(F.broadcast(keys), key, "left_semi")
    return _sifted(df, keys, key).filter(SIEVE).drop(SIEVE).join(keys, key, "left_semi")


def _sifted(df: DataFrame, keys: DataFrame, key: str | list[str]) -> DataFrame:
    names = [key] if isinstance(key, str) else list(key)
    # Types as in the table, since other ones hash to other places.
    typed = keys.select(*(F.col(f"`{name}`").cast(df.schema[name].dataType).alias(name) for name in names))
    bitmap, bits = bit_map(typed, names, keys.count())
    return marked(df, names, materialise(bitmap, "bits"), bits, SIEVE)


def lookup(
    df: DataFrame,
    table: DataFrame,
    key: str,
    how: str = "left",
    rows: int | None = None,
    counted: DataFrame | None = None,
    written: bool = False,
) -> DataFrame:
    """Join ``df`` to ``table``, which holds each key once.

    A key with more than 1/64 of the rows of ``df`` would put them all into one
    task. There are fewer than 64 such keys, so their table rows are broadcast
    and only the others are shuffled. ``counted`` is a written table with the
    same keys as ``df``, if ``df`` itself would have to be computed to be counted.
    If ``df`` is ``written`` (or ``counted`` is given) and has few rows, the table does
    not move: the keys, of measured size, go to its scan, and only the rows they hit
    are joined.
    """
    counted = df if counted is None else counted
    rows = counted.count() if rows is None else rows
    if (written or counted is not df) and rows <= BROADCAST_ROWS:
        keys = counted.select(key).distinct()
        if _bytes(keys) <= BROADCAST_BYTES:
            return df.join(table.join(F.broadcast(keys), key, "left_semi"), key, how)
    if rows <= SMALL_ROWS:
        return df.join(table, key, how)
    counts = counted.filter(F.col(key).isNotNull()).groupBy(key).count()
    hot = [r[0] for r in counts.filter(F.col("count") > rows * HOT_SHARE).select(key).collect()]
    if not hot:
        return df.join(table, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    some = df.filter(is_hot).join(F.broadcast(table.filter(F.col(key).isin(hot))), key, how)
    rest = df.filter(~is_hot).join(table.filter(~F.col(key).isin(hot)), key, how)
    return some.unionByName(rest)
