"""Rows whose key may be among many keys, told by bits and without moving a row.

Keys are hashed to places of a bit map, which is a table of rows of 4 KB. Every task gets
the map; a row whose bit is not set has none of the keys for sure. At most an eighth
of the bits are set, so of the other rows only so many are hits by chance, and the exact
join behind the sieve moves the hits alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: bits of one row of Spark's bit maps.
ROW_BITS = 32_768
#: Bits for each key, and the largest map that is sent to all tasks.
SHARE = 8
LARGEST = 1 << 30


def _place(keys: list[str], bits: int) -> Column:
    return F.pmod(F.xxhash64(*(F.col(f"`{name}`") for name in keys)), F.lit(bits)) + 1


def bit_map(keys: DataFrame, names: list[str], count: int) -> tuple[DataFrame, int]:
    """``bucket, bits`` and the number of places for a table of ``count`` keys, at most 128 MB."""
    bits = ROW_BITS
    while bits < count * SHARE and bits < LARGEST:
        bits *= 2
    place = _place(names, bits)
    rows = keys.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("position"))
    return rows.groupBy("bucket").agg(F.bitmap_construct_agg("position").alias("bits")), bits


def marked(df: DataFrame, names: list[str], bitmap: DataFrame, bits: int, name: str) -> DataFrame:
    """``df`` with a flag: whether the bit of its key is set. A null is a key like any other."""
    place = _place(names, bits)
    found = F.broadcast(bitmap.select(F.col("bucket").alias("__bucket"), F.col("bits").alias("__bits")))
    joined = df.select("*", F.bitmap_bucket_number(place).alias("__bucket"), F.bitmap_bit_position(place).alias("__position"))
    joined = joined.join(found, "__bucket", "left")
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(F.col("__position") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    mask = F.element_at(F.array(*(F.lit(1 << k) for k in range(8))), (F.col("__position") % 8 + 1).cast("int"))
    flag = F.coalesce(byte.bitwiseAND(mask) > 0, F.lit(False))
    return joined.select(*(F.col(f"`{column}`") for column in df.columns), flag.alias(name))
