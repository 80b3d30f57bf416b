"""Mixing sources to target weights by Efraimidis-Spirakis sampling (operator 5).

Every document gets an exponential key, ``-ln(u) / weight``, with ``u`` from a hash of
its id. Within a source, documents in key order are a weighted sample without
replacement of any length, so a budget of words is a prefix of that order. A target
beyond the source's size is first met by complete epochs, the rest by such a prefix.

All steps are DataFrame operations. The prefix of a source is found by sorting all
documents by (source, key) over all tasks and summing in two levels, within a task's
range and over the ranges, so a source with a third of all rows is spread like any
other. What comes out is one row per source with the last key taken; whether a
document is taken is then a comparison within its row, and texts never move.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import fits_broadcast
from ..session import materialise

WEIGHTS = (1, 2, 3)
CAP = 3
SEED = 11
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def exponential_key(doc_id: Column, weight: Column, seed: int = SEED) -> Column:
    """Exponential with rate ``weight``; the same for the same id on every run."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 12)
    uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)
    return -F.log(uniform) / weight.cast("double")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``source, source_size`` with ``target``: shares by weight, none above ``cap`` sizes.

    ``sizes`` has one row per source. Sources in code-point order, null last, take the
    weights in turn. Sources are filled in the order in which they reach their cap, so
    whether one is capped depends on those before it only: no rounds are needed.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.get(F.array(*map(F.lit, weights)), (place - 1) % len(weights)).cast("double")
    limit = F.col("source_size").cast("double") * cap
    filled = Window.orderBy(F.col("limit") / F.col("share"), F.col("source").asc_nulls_last())
    earlier, everyone = filled.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    plan = sizes.select("source", "source_size", weight.alias("share"), limit.alias("limit"))
    plan = plan.select(
        "*",
        F.coalesce(F.sum("limit").over(earlier), F.lit(0.0)).alias("limits"),
        F.coalesce(F.sum("share").over(earlier), F.lit(0.0)).alias("shares"),
        F.sum("share").over(everyone).alias("all_shares"),
        F.sum(F.col("source_size").cast("double")).over(everyone).alias("total"),
    )
    plan = plan.withColumn("level", (F.col("total") - F.col("limits")) / (F.col("all_shares") - F.col("shares")))
    plan = plan.withColumn("capped", F.col("limit") <= F.col("share") * F.col("level"))
    # Levels fall from the first source that is not capped on: its own holds for all that follow.
    plan = plan.withColumn("final", F.max(F.when(~F.col("capped"), F.col("level"))).over(everyone))
    target = F.when(F.col("capped"), F.col("limit")).otherwise(F.col("share") * F.col("final"))
    return plan.select("source", "source_size", target.alias("target"))


def mix_plan(
    docs: DataFrame,
    weight: Column | None = None,
    weights: Sequence[int] = WEIGHTS,
    cap: int = CAP,
    seed: int = SEED,
) -> DataFrame:
    """One row per source: ``source, source_size, target, epochs, last_taken``.

    ``docs`` needs ``doc_id, text, source``; ``weight`` is the quality weight of a row,
    positive, by default 1. ``last_taken`` is the (key, id, hash) of the last document
    of the fractional epoch: one belongs to it if at least half of it fits the budget.
    """
    sized = docs.select(*_sized(docs, weight, seed))
    placed = sized.repartitionByRange("source", "place").withColumn("part", F.spark_partition_id())
    placed = materialise(placed, "mix")
    sums = placed.groupBy("source", "part").agg(F.sum("size").alias("words"))
    ranges = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("source", "part", F.coalesce(F.sum("words").over(ranges), F.lit(0)).alias("before"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = targets.withColumn("epochs", F.least(epochs, F.lit(cap)).cast("long"))
    budgets = targets.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    offsets = before.join(budgets.select(F.col("source").alias("of"), "budget"), F.col("source").eqNullSafe(F.col("of")))
    offsets = offsets.select(F.col("part").alias("in_part"), "of", "before", "budget")
    inside = Window.partitionBy("part", "source").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    running = placed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    running = running.join(offsets, (F.col("part") == F.col("in_part")) & F.col("source").eqNullSafe(F.col("of")))
    half = F.col("before") + F.col("inside") + F.col("size") / 2.0
    cuts = running.filter(half < F.col("budget")).groupBy("source").agg(F.max("place").alias("last_taken"))
    cuts = cuts.withColumnRenamed("source", "cut_of")
    plan = targets.join(cuts, F.col("source").eqNullSafe(F.col("cut_of")), "left").drop("cut_of")
    return materialise(plan, "mix-plan")


def _sized(docs: DataFrame, weight: Column | None, seed: int) -> list[Column]:
    key = exponential_key(docs["doc_id"], F.lit(1.0) if weight is None else weight, seed)
    size, mark = (docs["__measure"]["size"], docs["__measure"]["hash"]) if "__measure" in docs.columns else _measure(docs)
    place = F.struct(key.alias("key"), docs["doc_id"].alias("id"), mark.alias("hash"))
    return [docs["source"].alias("source"), place.alias("place"), size.alias("size")]


def _measure(docs: DataFrame) -> tuple[Column, Column]:
    return word_count(docs["text"]), F.xxhash64(docs["text"])


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id, source`` and what ``mix`` needs of the texts, so that it can do without them."""
    size, mark = _measure(docs)
    return docs.select(docs["doc_id"], docs["source"], F.struct(size.alias("size"), mark.alias("hash")).alias("__measure"))


def mix(
    docs: DataFrame,
    weight: Column | None = None,
    weights: Sequence[int] = WEIGHTS,
    cap: int = CAP,
    seed: int = SEED,
    name: str = "mix",
) -> DataFrame:
    """``docs`` with ``mix``, or another ``name``, added, a struct of ``size, source_size, target, copies, taken``.

    ``copies`` is how often the mix holds the document, 0 to ``cap`` times. Null or
    empty texts have size 0; a null source is a source of its own, a null id is hashed
    as an empty one. Repeated rows share a key and are taken together. An empty table
    gives an empty result. A column of that name is replaced; others stay.
    """
    plan = mix_plan(docs, weight, weights, cap, seed).select(F.struct("*").alias("__plan"))
    source, place, size = _sized(docs, weight, seed)
    rows = docs.select(
        *(docs[f"`{column}`"] for column in docs.columns if column != name),
        F.struct(source.alias("source"), place.alias("place"), size.alias("size")).alias("__doc"),
    )
    joined = rows.join(plan, F.col("__doc.source").eqNullSafe(F.col("__plan.source")))
    extra = F.coalesce(F.col("__doc.place") <= F.col("__plan.last_taken"), F.lit(False)).cast("long")
    copies = F.least(F.col("__plan.epochs") + extra, F.lit(cap))
    mixed = F.struct(
        F.col("__doc.size").alias("size"),
        F.col("__plan.source_size").alias("source_size"),
        F.col("__plan.target").alias("target"),
        copies.cast("long").alias("copies"),
        (copies * F.col("__doc.size")).cast("long").alias("taken"),
    )
    return joined.select(*(f"`{column}`" for column in docs.columns if column != name), mixed.alias(name))


def copies_of(mixed: DataFrame, name: str = "mix") -> DataFrame:
    """The mix itself: every document as often as it was taken, without the column of ``mix``."""
    copies = F.col(f"`{name}`")["copies"]
    rows = mixed.filter(copies > 0).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    return rows.drop(name, "__copy")


def label_weight(docs: DataFrame, labels: DataFrame, good: float = 2.0, poor: float = 0.5) -> tuple[DataFrame, str]:
    """``docs`` with a weight by the quality label; 1 where there is none. Also the new column's name.

    Labels of a measured small size go to the documents; else both are shuffled, so give
    ``measured`` rows where texts are not needed.
    """
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("__quality"))
    marks = materialise(marks.withColumnRenamed("doc_id", "__labelled"), "marks")
    marks = F.broadcast(marks) if fits_broadcast(marks) else marks
    joined = docs.join(marks, docs["doc_id"] == marks["__labelled"], "left")
    weight = F.when(F.col("__quality") == 1, good).when(F.col("__quality") == 0, poor).otherwise(1.0)
    return joined.withColumn("__weight", weight).drop("__labelled", "__quality"), "__weight"
