"""Mixing against a plain water-filling loop and a plain pass over sorted documents."""

import math

import pytest
from pyspark.sql import functions as F

from cardmill.llm.mixing import copies_of, mix, source_targets

SCHEMA = "doc_id long, text string, source string, size string, mix string"


def filled(sizes, weights=(1, 2, 3), cap=3):
    """Targets by giving out what is left, round by round."""
    order = sorted((name for name in sizes if name is not None)) + ([None] if None in sizes else [])
    share = {name: weights[place % len(weights)] for place, name in enumerate(order)}
    left, targets, free = float(sum(sizes.values())), {}, set(order)
    while free:
        level = left / sum(share[name] for name in free)
        full = {name for name in free if cap * sizes[name] <= share[name] * level}
        if not full:
            return targets | {name: share[name] * level for name in free}
        targets |= {name: float(cap * sizes[name]) for name in full}
        left -= sum(cap * sizes[name] for name in full)
        free -= full
    return targets


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 10, "c": 10}, {"a": 1000, "b": 1, "c": 2, None: 3}, {"é": 0, "z": 500, "a": 7, "b": 90000},
    {"only": 12}, {str(i): i * i % 97 for i in range(40)}, {"a": 0, "b": 0},
])
def test_targets(spark, sizes):
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {row["source"]: row["target"] for row in source_targets(table).collect()}
    wanted = filled(sizes)
    assert found.keys() == wanted.keys()
    assert all(math.isclose(found[name], wanted[name], rel_tol=1e-9, abs_tol=1e-9) for name in wanted)
    assert math.isclose(sum(found.values()), sum(sizes.values()), rel_tol=1e-9, abs_tol=1e-9)


def test_mix_meets_targets(spark):
    rows = [(i, " ".join(["w"] * (i % 17 + 1)), "big" if i % 3 else "small" if i % 2 else None, "x", "y") for i in range(900)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    mixed = mix(docs)
    assert mixed.columns == ["doc_id", "text", "source", "size", "mix"]
    found = mixed.collect()
    assert len(found) == 900
    sums, targets, longest = {}, {}, 17
    for row in found:
        part = row["mix"]
        assert part["size"] == row["doc_id"] % 17 + 1
        assert part["taken"] == part["copies"] * part["size"] <= 3 * part["size"]
        sums[row["source"]] = sums.get(row["source"], 0) + part["taken"]
        targets[row["source"]] = part["target"]
    assert all(abs(sums[name] - targets[name]) <= longest / 2 + 1e-9 for name in sums)
    # Complete epochs first: copies within a source differ by one at most.
    for name in sums:
        copies = {row["mix"]["copies"] for row in found if row["source"] == name}
        assert max(copies) - min(copies) <= 1
    again = {row["doc_id"]: row["mix"] for row in mix(docs.repartition(3)).collect()}
    assert again == {row["doc_id"]: row["mix"] for row in found}
    assert copies_of(mixed).count() == sum(row["mix"]["copies"] for row in found)


def test_heavier_documents_come_first(spark):
    rows = [(i, "w", source, None, None) for i in range(4000) for source in (["a"] if i < 3000 else ["b"])]
    docs = spark.createDataFrame(rows, SCHEMA)
    heavy = F.col("doc_id") % 2 == 0
    mixed = mix(docs, F.when(heavy, 4.0).otherwise(1.0)).filter("source = 'a'").groupBy(heavy.alias("heavy"))
    taken = {row["heavy"]: row["n"] for row in mixed.agg(F.sum("mix.copies").alias("n")).collect()}
    assert taken[True] > 1.5 * taken[False]


def test_nulls_empty_and_repeated_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "a", None, None), (2, "x y", "a", None, None),
            (2, "x y", "a", None, None), (3, " \t\n", None, None, None), (4, "é z", None, None, None)]
    found = mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(row["mix"]["size"] for row in found) == [0, 0, 0, 1, 2, 2]
    pair = [row["mix"] for row in found if row["doc_id"] == 2]
    assert pair[0] == pair[1]
    assert mix(spark.createDataFrame([], SCHEMA)).collect() == []
