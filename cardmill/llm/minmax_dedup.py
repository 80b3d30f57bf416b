"""Near-duplicate documents by min-max hashing (operator 1).

Every permutation of the shingles gives two values, its minimum and its maximum, so a
signature of 384 values takes 192 permutations. Six values make a band, 64 bands a
signature: two texts with a similarity of 0.75 share no band with a chance of 4e-6.

Texts with equal shingle sets are one class, known by a 128-bit sum of the set. Bands
of the classes only propose pairs. Links are confirmed on the full sets, recomputed
from the whole texts:

* a few rounds in which each class is compared with the most connected class of its
  buckets, which joins a large group of copies by a number of pairs in proportion to
  its size; after each round the components so far are known;
* then all pairs that share a bucket and lie in different components, none left out. If
  these are many (a large group whose members are alike, yet not alike enough), a pair
  is first asked to share one of its rarest shingles: two sets that are linked have
  ``common`` shingles in common at least, by their sizes, so the ``size - common + 1``
  rarest of the one and of the other share one, in whatever order shingles are rare.

A bucket is only ever counted and joined, never gathered, and a comparison runs
through its rows in a stream, in chunks of one class's partners.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import drop_keys, fits_broadcast, keep_keys
from ..session import materialise
from .arrow import lists, raw_texts, text_slices
from .components import connected_components
from .shingles import mixed, shingle_hashes, shingle_sets

PERCENT = 75
BANDS = 64
ROWS = 6
#: Pairs for each class that may still be unjoined when all of them are compared, and rounds before that.
PAIRS_EACH = 8
ROUNDS = 2
#: Streams that the partners of one class are dealt out to.
CHUNKS = 1024
#: Bytes of texts whose shingles are held at once.
SLICE = 1 << 20

_CHANCE = np.random.Generator(np.random.PCG64(7))
_TURNS = _CHANCE.integers(0, 1 << 31, BANDS * ROWS // 2, np.uint32) << np.uint32(1) | np.uint32(1)
_SHIFTS = _CHANCE.integers(0, 1 << 32, BANDS * ROWS // 2, np.uint32)
_FOLDS = _CHANCE.integers(1, 1 << 63, ROWS, np.uint64) << np.uint64(1) | np.uint64(1)

SIGNED = "doc_id long, n_shingles long, low long, high long, bands array<long>"


def min_max(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Minima, then maxima, of every permutation for each run of shingles (none empty)."""
    values = (hashes >> np.uint64(32)).astype(np.uint32)
    found = np.empty((2 * len(_TURNS), len(starts)), np.uint32)
    for k, (turn, shift) in enumerate(zip(_TURNS, _SHIFTS, strict=True)):
        turned = values * turn + shift
        found[k] = np.minimum.reduceat(turned, starts)
        found[len(_TURNS) + k] = np.maximum.reduceat(turned, starts)
    return found


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key of every band: one row per text, one column per band."""
    rows = signatures.reshape(BANDS, ROWS, -1).astype(np.uint64)
    folded = (rows * _FOLDS[None, :, None]).sum(axis=1, dtype=np.uint64)
    return np.stack([mixed(folded[band], band + 1) for band in range(BANDS)], axis=1)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, 1, SLICE):
        hashes, offsets = shingle_hashes(raw_texts(batch.column(1)))
        sets = [np.unique(hashes[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        sums = [[int(mixed(own, salt).sum(dtype=np.uint64).astype(np.int64)) for own in sets] for salt in (50, 51)]
        filled = np.diff(offsets) > 0
        keys = np.zeros((int(filled.sum()), BANDS), np.uint64)
        if filled.any():
            keys = band_keys(min_max(hashes, offsets[:-1][filled]))
        ends = np.concatenate([[0], np.cumsum(filled * BANDS)])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).cast(pa.int64()),
                pa.array([len(own) for own in sets], pa.int64()),
                *(pa.array(values, pa.int64()) for values in sums),
                lists(keys.ravel().view(np.int64), ends),
            ],
            ["doc_id", "n_shingles", "low", "high", "bands"],
        )


def _similar(one: np.ndarray, other: np.ndarray, percent: int) -> bool:
    # Sizes alone may rule a pair out.
    if 100 * min(len(one), len(other)) < percent * max(len(one), len(other)) or not len(one):
        return False
    at = np.minimum(np.searchsorted(one, other), len(one) - 1)
    both = int((one[at] == other).sum())
    return 100 * both >= percent * (len(one) + len(other) - both)


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs ``hub, id`` whose full shingle sets are similar enough, as ``a, b``.

    ``texts`` has ``id, text``; an id with several texts is linked by any of them. The
    partners of a hub are dealt out in chunks; each chunk is a sorted stream that starts
    with the hub's text.
    """
    chunk = F.pmod(F.xxhash64("id"), F.lit(CHUNKS)).alias("chunk")
    dealt = materialise(pairs.select("hub", chunk, "id"), "pairs")
    hubs = dealt.select("hub", "chunk", F.col("hub").alias("id")).distinct().withColumn("partner", F.lit(0))
    rows = hubs.unionByName(dealt.withColumn("partner", F.lit(1))).join(texts, "id")
    rows = rows.repartition("hub", "chunk").sortWithinPartitions("hub", "chunk", "partner")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[np.ndarray] = []
        partners_before = True
        for batch in text_slices(batches, 3, SLICE):
            found = []
            sets = shingle_sets(raw_texts(batch.column(3)))
            hubs, ids, partners = (batch.column(k).to_pylist() for k in range(3))
            for hub, key, partner, other in zip(hubs, ids, partners, sets, strict=True):
                if partner:
                    if any(_similar(one, other, percent) for one in own):
                        found.append((hub, key))
                else:
                    own = [other] if partners_before else [*own, other]
                partners_before = bool(partner)
            yield pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"]
            )

    return rows.select("hub", "id", "partner", "text").mapInArrow(compare, "a long, b long")


def _rare_pairs(live: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs in different components that share one of their rarest shingles: all that can be linked are among them."""
    members = materialise(live.select("id", "component").distinct(), "open")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 2, SLICE):
            sets = shingle_sets(raw_texts(batch.column(2)))
            sizes = np.array([len(own) for own in sets], np.int64)
            at = np.repeat(np.arange(len(sets)), sizes)
            # An id may have several sets: each has a mark of its own.
            marks = np.array([int(own.sum(dtype=np.uint64).astype(np.int64)) for own in sets], np.int64)
            flat = np.concatenate(sets).view(np.int64) if len(at) else np.zeros(0, np.int64)
            columns = [batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), *map(pa.array, (marks[at], sizes[at], flat))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "component", "mark", "size", "shingle"])

    rows = texts.join(members, "id").select("id", "component", "text")
    rows = materialise(rows.mapInArrow(explode, "id long, component long, mark long, size long, shingle long"), "open-shingles")
    rarity = materialise(rows.groupBy("shingle").agg(F.count("*").alias("holders")), "rarity")
    # A shingle of one holder takes a place among the rarest, yet pairs nobody.
    place = F.row_number().over(Window.partitionBy("id", "mark").orderBy("holders", "shingle"))
    wanted = F.col("size") - F.ceil(F.col("size") * percent / 100) + 1
    # Enough for the smaller set of a pair.
    short = F.col("size") - F.ceil(2 * F.col("size") * percent / (100 + percent)) + 1
    rarest = rows.join(rarity, "shingle").withColumn("place", place).filter(F.col("place") <= wanted)
    rarest = materialise(rarest.filter("holders > 1").select("id", "component", "size", "shingle", "place", short.alias("short")), "rarest")
    one, two = rarest.filter("place <= short").alias("one"), rarest.alias("two")
    small, large = F.col("one.size"), F.col("two.size")
    common = F.ceil((small + large) * percent / (100 + percent))
    ordered = (small < large) | ((small == large) & (F.col("one.id") < F.col("two.id")))
    fits = ordered & (100 * small >= percent * large) & (F.col("one.component") != F.col("two.component"))
    fits = fits & (F.col("one.place") <= small - common + 1) & (F.col("two.place") <= large - common + 1)
    both = one.join(two, (F.col("one.shingle") == F.col("two.shingle")) & fits)
    return both.select(F.col("two.id").alias("hub"), F.col("one.id").alias("id")).distinct()


def _live(buckets: DataFrame, components: DataFrame, number: int) -> DataFrame:
    """Rows of the buckets that still hold several components, with the bucket's size and leading class.

    First the most connected class leads, in later rounds another one, by a hash.
    """
    weight = F.col("degree") if number == 0 else F.xxhash64("id", F.lit(number))
    labelled = buckets.select("key", "id", weight.alias("weight"))
    if number:
        labelled = labelled.join(components, "id", "left")
    else:
        labelled = labelled.withColumn("component", F.lit(None).cast("long"))
    labelled = materialise(labelled.withColumn("component", F.coalesce("component", "id")), "labelled")
    sides = labelled.groupBy("key").agg(
        F.count("*").alias("size"), F.min("component").alias("low"), F.max("component").alias("high"),
        F.max(F.struct("weight", "id", "component")).alias("lead"),
    )
    sides = materialise(sides.filter("low < high").select("key", "size", "lead"), "sides")
    return materialise(labelled.join(sides, "key"), "live")


def _led(live: DataFrame) -> DataFrame:
    """Pairs of each class with the leading classes of its buckets, four at most, in other components."""
    led = live.filter(F.col("component") != F.col("lead.component"))
    best = led.groupBy("id", F.pmod("key", F.lit(4)).alias("part")).agg(F.max("lead").alias("lead"))
    return best.select(F.col("lead.id").alias("hub"), "id").distinct()


def _open_pairs(live: DataFrame) -> int:
    """Bound of the pairs of different components that share a bucket."""
    outside = F.when(F.col("component") != F.col("lead.component"), F.col("size").cast("double"))
    return int(live.agg(F.coalesce(F.sum(outside), F.lit(0.0))).first()[0])


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs`` (``doc_id`` an integer, ``text``): ``doc_id, n_shingles, component_id, kept``.

    Two documents are linked if ``100 * intersection >= percent * union`` of their sets
    of 5-word shingles (A-Z as a-z; a shorter text is one shingle). ``component_id`` is
    the smallest ``doc_id`` that links reach, ``kept`` marks the documents that are it.
    Null, empty and blank texts have an empty set and stay alone. Rows with the same id
    count as one document, each with its own ``n_shingles``; a null id has a null
    component, is linked with nothing and kept. An empty table gives an empty result.
    Other columns are ignored, whatever their names.
    """
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    signed = materialise(own.mapInArrow(_sign, SIGNED), "signed")
    alike = ["n_shingles", "low", "high"]
    classes = signed.filter("n_shingles > 0").groupBy(*alike).agg(F.min("doc_id").alias("class"))
    classes = materialise(classes.filter("class is not null"), "classes")
    members = signed.select("doc_id", *alike).join(classes, alike, "left")
    members = materialise(members.select("doc_id", "n_shingles", "class"), "members")
    links = _links(own, signed, classes, alike, percent)
    # Rows that share an id, or a set, are one: both are links like any other.
    same = members.filter("doc_id <> class").select(F.col("doc_id").alias("a"), F.col("class").alias("b"))
    several = members.filter("class is not null and doc_id is not null").groupBy("doc_id")
    several = several.agg(F.min("class").alias("b"), F.max("class").alias("c")).filter("b < c")
    repeated = several.select("doc_id").join(same, F.col("doc_id") == F.col("a")).select("a", "b")
    found = connected_components(links.unionByName(repeated))
    joined = members.join(found, F.coalesce("class", "doc_id") == found["id"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "class", "doc_id"))
    return joined.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def _links(docs: DataFrame, signed: DataFrame, classes: DataFrame, alike: list[str], percent: int) -> DataFrame:
    spark = docs.sparkSession
    none = spark.createDataFrame([], "a long, b long")
    first = signed.join(classes.select(*alike, F.col("class").alias("doc_id")), [*alike, "doc_id"])
    bands = first.select(F.col("doc_id").alias("id"), F.explode("bands").alias("key"))
    sides = bands.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    shared = materialise(sides.filter("low < high").select("key"), "shared")
    buckets = materialise(bands.join(shared, "key").distinct(), "shared-bands")
    degrees = materialise(buckets.groupBy("id").agg(F.count("*").alias("degree")), "degrees")
    if degrees.isEmpty():
        return none
    ids = degrees.select("id")
    wanted = docs.join(F.broadcast(ids) if fits_broadcast(ids) else ids, docs["doc_id"] == ids["id"], "left_semi")
    texts = materialise(wanted.select(F.col("doc_id").alias("id"), "text").distinct(), "texts")
    buckets = buckets.join(degrees, "id")
    every, found = degrees.count(), none
    components = spark.createDataFrame([], "id long, component long")
    for number in range(ROUNDS + 1):
        live = _live(buckets, components, number)
        open_pairs = _open_pairs(live)
        if not open_pairs:
            break
        few = open_pairs <= PAIRS_EACH * every
        last = few or number == ROUNDS
        if last and not few:
            pairs = _rare_pairs(live, texts, percent)
        elif last:
            other = live.select("key", F.col("id").alias("hub"), F.col("component").alias("of"))
            pairs = live.join(other, "key").filter("component < of").select("hub", "id").distinct()
        else:
            pairs = _led(live)
        found = found.unionByName(materialise(confirmed(pairs, texts, percent), "confirmed"))
        if last:
            break
        components = materialise(connected_components(found), "components")
    return found


def without_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the documents that ``near_duplicates`` does not keep, and without repeated rows; texts do not move.

    One document of every group stays. Rows that share an id are one document to
    ``near_duplicates``: of those with the same text one stays. A row without an id goes if another
    row has its text; nothing can name it in a link, so it is not compared further.
    """
    found = near_duplicates(docs, percent).filter("not kept").select("doc_id").distinct()
    several = docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").select("doc_id")
    several = materialise(several, "several")
    rest = drop_keys(docs, found, "doc_id")
    if several.isEmpty():
        return rest
    # Only rows that their id does not tell apart are numbered, and only numbers and digests of them move.
    plain = drop_keys(rest.filter("doc_id is not null"), several, "doc_id")
    odd = keep_keys(rest.filter("doc_id is not null"), materialise(several.filter("doc_id is not null"), "several"), "doc_id")
    odd = odd.unionByName(rest.filter("doc_id is null")).withColumn("__row", F.monotonically_increasing_id())
    odd = materialise(odd, "odd")
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("digest")
    marks = odd.select("__row", "doc_id", digest)
    first = marks.groupBy("doc_id", "digest").agg(F.min("__row").alias("__row"))
    known = materialise(docs.filter("doc_id is not null").select(digest).distinct(), "digests")
    unknown = drop_keys(first.filter("doc_id is null"), known, "digest")
    stay = materialise(first.filter("doc_id is not null").unionByName(unknown).select("__row"), "stay")
    return plain.unionByName(keep_keys(odd, stay, "__row").drop("__row"))
