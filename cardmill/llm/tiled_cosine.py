"""Embedding near-duplicates by PCA-ordered tiled comparison (operator 4).

All vectors with the same label (and length) are compared, exactly. Equal vectors are
one class and compared once. Unit vectors are turned to their principal axes; tiles of
neighbours in cells of the leading axes are cut out of one sort of all rows. Two tiles meet
only if they share a cell that is as wide as a link is long, and if the boxes of their
leading coordinates are close enough for the threshold. Within a pair of tiles products are
summed over leading dimensions first, then over twice as many, and so on: what is left
is bounded by the norms of the rest, and only products that can still reach the
threshold go on. A pair of tiles gives a row per vector with its number of links and
its smallest linked vector within the pair, so a dense group of a million links is a
few thousand rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .components import connected_components

THRESHOLD = 0.93
#: Vectors of a tile: a pair of tiles is what one task holds at a time.
TILE = 1024
#: Leading dimensions of the first sum, those of a tile's box, and those cut into cells.
LEADING = 16
BOX = 6
CELLS = 3
#: Tiles of a cell that one task compares with the cell's others.
CELL_TILES = 4096
SLACK = 1e-9


def usable(vector) -> F.Column:
    """Not null, not zero, and without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows, in double precision."""
    size = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(size, -1)


def units(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1, without overflow for very large components."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def by_length(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, split by the length of their vectors."""
    lengths = batch.column(column).value_lengths().to_numpy(zero_copy_only=False)
    for length in np.unique(lengths):
        yield batch.take(pa.array(np.flatnonzero(lengths == length)))


def principal_axes(vectors: DataFrame, column: str = "vector") -> dict[int, np.ndarray]:
    """Per vector length, the axes of the unit vectors as columns, largest spread first.

    Second moments are summed over all rows by Spark; the driver gets one square matrix
    per length.
    """

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part in by_length(batch, column):
                rows = units(matrix(part.column(column)))
                sums[rows.shape[1]] = sums.get(rows.shape[1], 0) + rows.T @ rows
        for size, total in sums.items():
            columns = [np.full(size * size, size), np.arange(size * size), total.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["size", "place", "value"])

    parts = vectors.select(column).mapInArrow(moments, "size long, place long, value double")
    axes = {}
    for size, values in (
        parts.groupBy("size", "place").agg(F.sum("value").alias("value")).groupBy("size")
        .agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("cells")).collect()
    ):
        square = np.array([cell["value"] for cell in values]).reshape(size, size)
        axes[size] = np.linalg.eigh(square)[1][:, ::-1].copy()
    return axes


def _tiles(classes: DataFrame, axes: dict[int, np.ndarray], reach: float) -> DataFrame:
    """Classes with a tile number and the leading coordinates, in one sort of all rows.

    Rows are sorted by their cells, ``reach`` wide, before the first coordinate, so that a tile is
    narrow along some axes and not only along the first, where a large label is narrow anyway.
    """
    extra = "label, class, copies, vector"
    names = ["label", "class", "copies", "vector", "length", "lead"]
    kinds = {field.name: field.dataType.simpleString() for field in classes.schema}
    kept = ", ".join(f"{name} {kinds[name]}" for name in extra.split(", "))

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_length(batch, "vector"):
                rows = units(matrix(part.column("vector")))
                lead = (rows @ axes[rows.shape[1]])[:, :BOX]
                columns = [part.column(name) for name in extra.split(", ")]
                width = lead.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(range(0, lead.size + 1, width), pa.int32()), pa.array(lead.ravel()))
                yield pa.RecordBatch.from_arrays([*columns, pa.array([rows.shape[1]] * len(rows), pa.int32()), lists], names)

    turned = classes.select(*extra.split(", ")).mapInArrow(turn, f"{kept}, length int, lead array<double>")
    cells = [F.floor(F.get("lead", F.lit(k)) / reach) for k in range(CELLS)]
    order = ["label", "length", *cells, F.col("lead")[0], "class"]
    ranged = turned.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held, before = -1, TILE, None
        for batch in batches:
            found = []
            part = batch.column("part").to_numpy(zero_copy_only=False)
            for group in zip(batch.column("label").to_pylist(), batch.column("length").to_pylist(), strict=True):
                if group != before or held == TILE:
                    tile, held, before = tile + 1, 0, group
                held += 1
                found.append(tile)
            tiles = (part.astype(np.int64) << 40) + np.array(found, np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(name) for name in names), pa.array(tiles)], [*names, "tile"])

    return ranged.mapInArrow(cut, f"{kept}, length int, lead array<double>, tile long")


def _near_tiles(tiles: DataFrame, threshold: float, reach: float) -> DataFrame:
    """Pairs ``one <= two`` of tiles of a label whose boxes are close enough.

    Unit vectors with a cosine of t are ``sqrt(2 - 2 t)``, the ``reach``, apart, and boxes of
    leading coordinates are no further apart than the vectors in them. Boxes widened by half the
    reach meet if they are that close, so they share a cell; the first one that they share
    reports them. A cell of many tiles is dealt out over several tasks.
    """
    lead = [F.get("lead", F.lit(k)) for k in range(BOX)]
    boxes = tiles.groupBy("label", "length", "tile").agg(
        *(F.min(x).alias(f"low{k}") for k, x in enumerate(lead)), *(F.max(x).alias(f"high{k}") for k, x in enumerate(lead))
    )
    half = reach / 2
    for k in range(CELLS):
        # Vectors with fewer dimensions have one cell along the others.
        boxes = boxes.withColumn(f"from{k}", F.coalesce(F.floor((F.col(f"low{k}") - half) / reach), F.lit(0)))
        boxes = boxes.withColumn(f"to{k}", F.coalesce(F.floor((F.col(f"high{k}") + half) / reach), F.lit(0)))
    for k in range(CELLS):
        boxes = boxes.withColumn(f"cell{k}", F.explode(F.sequence(f"from{k}", f"to{k}")))
    cell = ["label", "length", *(f"cell{k}" for k in range(CELLS))]
    boxes = materialise(boxes.drop(*(f"to{k}" for k in range(CELLS))), "boxes")
    shares = boxes.groupBy(*cell).agg(F.ceil(F.count("*") / CELL_TILES).alias("shares"))
    boxes = materialise(boxes.join(shares, cell), "cells")
    one = boxes.withColumn("share", F.pmod(F.xxhash64("tile"), "shares")).alias("one")
    two = boxes.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))).alias("two")
    zero = F.lit(0.0)
    gaps = [
        F.coalesce(F.greatest(F.col(f"one.low{k}") - F.col(f"two.high{k}"), F.col(f"two.low{k}") - F.col(f"one.high{k}"), zero), zero)
        for k in range(BOX)
    ]
    apart = sum((gap * gap for gap in gaps[1:]), gaps[0] * gaps[0])
    meet = (F.col("one.tile") <= F.col("two.tile")) & (apart <= 2 - 2 * threshold + SLACK)
    for name in [*cell, "share"]:
        meet &= F.col(f"one.{name}") == F.col(f"two.{name}")
    for k in range(CELLS):
        meet &= F.col(f"one.cell{k}") == F.greatest(f"one.from{k}", f"two.from{k}")
    return one.join(two, meet).select(F.col("one.tile").alias("one"), F.col("two.tile").alias("two"))


def linked(left: np.ndarray, right: np.ndarray, axes: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of ``left`` the rows of ``right`` with a cosine of ``threshold`` at least.

    The leading dimensions are multiplied tile by tile, further ones, up to twice as many
    each time, only for the rows whose bound still reaches the threshold. What no bound rules out
    gets its exact cosine, on the vectors as given.
    """
    a, b = units(left), units(right)
    turned_a, turned_b = a @ axes, b @ axes
    size = a.shape[1]
    ends = [LEADING]
    while 2 * ends[-1] < size:
        ends.append(2 * ends[-1])
    rests_a, rests_b = ([np.sqrt((rows[:, end:] ** 2).sum(axis=1)) for end in ends] for rows in (turned_a, turned_b))
    product = turned_a[:, :LEADING] @ turned_b[:, :LEADING].T
    alive = product + rests_a[0][:, None] * rests_b[0][None, :] >= threshold - SLACK
    for i in np.flatnonzero(alive.any(axis=1)):
        may = np.flatnonzero(alive[i])
        sums = product[i, may]
        for step in range(1, len(ends)):
            span = slice(ends[step - 1], ends[step])
            sums = sums + turned_b[may, span] @ turned_a[i, span]
            keep = sums + rests_b[step][may] * rests_a[step][i] >= threshold - SLACK
            may, sums = may[keep], sums[keep]
            if not len(may):
                break
        if len(may):
            yield i, may[(b[may] * a[i]).sum(axis=1) >= threshold]


def near_vectors(
    table: DataFrame, threshold: float = THRESHOLD, key: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """One row per row of ``table``: ``key`` (an integer), ``n_links, component_id, kept``.

    Two vectors are linked if their labels are equal and not null, their lengths are
    equal and their cosine, in double precision, is at least ``threshold``. ``n_links``
    counts the other rows linked directly, ``component_id`` is the smallest key that
    links reach, ``kept`` marks the rows that are it. Vectors that are null, empty, zero
    or hold null or non-finite components, and rows without a label, are linked with
    nothing. Rows with equal vectors are linked with each other. A null key has a null
    component and is kept, yet counts as a link of others; rows that repeat a key are
    rows of their own in ``n_links`` and one in components. An empty table gives an empty
    result. Other columns are ignored.
    """
    spark = table.sparkSession
    fits = usable(table[vector]) & table[label].isNotNull()
    rows = table.select(
        table[key].cast("long").alias("key"), table[label].alias("label"),
        F.when(fits, F.transform(table[vector], lambda x: x.cast("double") + 0.0)).alias("vector"),
    )
    given = F.col("vector").isNotNull()
    prints = [F.when(given, F.xxhash64(*extra, "vector")).alias(name) for name, extra in (("low", ()), ("high", (F.lit(1),)))]
    rows = materialise(rows.select("*", *prints), "rows")
    alike = ["label", "low", "high"]
    groups = rows.filter("vector is not null").groupBy(*alike)
    classes = groups.agg(F.min("key").alias("least"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    # Numbers of rows cannot meet as hashes may; they are fixed once the table is written.
    classes = materialise(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    axes = principal_axes(classes)
    # Opposite vectors are 2 apart; a reach near 0 would make more cells than tiles.
    reach = max(math.sqrt(max(2 - 2 * threshold, 0.0)) + SLACK, 0.05)
    tiles = materialise(_tiles(classes, axes, reach), "tiles")
    pairs = materialise(_near_tiles(tiles, threshold, reach), "near-tiles")
    packed = tiles.select("tile", "class", "copies", "vector", "length")
    sides = pairs.select("one", "two", F.explode(F.array_distinct(F.array("one", "two"))).alias("tile"))
    met = sides.join(packed, "tile")

    def compare(pair: pa.Table) -> pa.Table:
        size = pair.column("length")[0].as_py()
        one = pair.column("one")[0].as_py()
        inside = np.array(pair.column("tile")) == one
        ids, copies = np.array(pair.column("class")), np.array(pair.column("copies"))
        vectors = matrix(pair.column("vector").combine_chunks())
        left = np.flatnonzero(inside)
        right = left if inside.all() else np.flatnonzero(~inside)
        links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i, found in linked(vectors[left], vectors[right], axes[size], threshold):
            others = right[found]
            others = others[others != left[i]]
            links[left[i]] += copies[others].sum()
            if right is not left:
                links[others] += copies[left[i]]
            # One link to each group is enough for components.
            for other in others[root[others] != top(left[i])]:
                root[top(other)] = top(left[i])
        roots = np.array([top(i) for i in range(len(ids))])
        return pa.table({"class": ids, "links": links, "linked": ids[roots]})

    found = met.groupBy("one", "two").applyInArrow(compare, "class long, links long, linked long")
    found = materialise(found.filter("links > 0"), "found")
    counts = found.groupBy("class").agg(F.sum("links").alias("links"))
    joined = connected_components(found.select(F.col("class").alias("a"), F.col("linked").alias("b")))
    # Components of classes, then the smallest key in each.
    named = classes.select(*alike, "class", "copies", "least").join(counts, "class", "left")
    named = named.join(joined.withColumnRenamed("id", "class"), "class", "left")
    named = materialise(named.withColumn("group", F.coalesce("component", "class")), "named")
    least = materialise(named.groupBy("group").agg(F.min("least").alias("first")), "least")
    named = materialise(named.join(least, "group").select(*alike, "copies", "links", "group", "first"), "classes")
    out = rows.select("key", *alike).join(named, alike, "left")
    out = materialise(out, "members")
    # A key that repeats may tie groups together.
    several = out.filter("key is not null and group is not null").groupBy("key")
    several = several.agg(F.min("group").alias("a"), F.max("group").alias("b")).filter("a < b")
    if not several.isEmpty():
        out = _tied(out, several)
    component = F.when(F.col("key").isNotNull(), F.coalesce("first", "key"))
    return out.select(
        F.col("key").alias(key),
        F.coalesce(F.coalesce("links", F.lit(0)) + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("key") == component, F.lit(True)).alias("kept"),
    )


def _tied(members: DataFrame, several: DataFrame) -> DataFrame:
    """Members whose groups share a key, with the smallest key of what hangs together."""
    links = members.select("key", F.col("group").alias("a")).join(several.select("key", F.col("a").alias("b")), "key")
    tied = connected_components(links.select("a", "b")).withColumnRenamed("id", "group")
    joined = members.join(tied, "group", "left").withColumn("tie", F.coalesce("component", "group"))
    joined = materialise(joined.drop("component"), "tied")
    least = materialise(joined.filter("tie is not null").groupBy("tie").agg(F.min("first").alias("least")), "ties")
    return joined.join(least, "tie", "left").withColumn("first", F.coalesce("least", "first"))
