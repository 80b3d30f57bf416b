"""Key joins beyond a broadcast: the same rows, and only hits are moved."""

import random

import pytest

from cardmill.operators import joins
from cardmill.operators.joins import drop_keys, keep_keys
from cardmill.operators.sieve import bit_map, marked
from cardmill.session import materialise


@pytest.mark.parametrize("kind", ["long", "string"])
def test_rows_with_and_without_keys(spark, monkeypatch, kind):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    chance = random.Random(5)
    values = [*range(3000), None]
    rows = [(None if value is None else str(value), chance.randrange(9)) for value in values for _ in range(chance.randrange(3))]
    df = spark.createDataFrame(rows, "k string, v int").selectExpr(f"cast(k as {kind}) as k", "v", "repeat('x', 100) as html")
    gone = {str(k) for k in chance.sample(range(3000), 700)}
    keys = spark.createDataFrame([(k,) for k in gone] + [(None,), ("9999999",)], "k string").selectExpr(f"cast(k as {kind}) as k")
    dropped = sorted((str(r["k"]), r["v"]) for r in drop_keys(df, keys, "k").collect())
    # A null equals nothing, so its rows stay.
    assert dropped == sorted((str(k), v) for k, v in rows if k not in gone)
    kept = sorted((str(r["k"]), r["v"]) for r in keep_keys(df, materialise(keys, "keys"), "k").collect())
    assert kept == sorted((str(k), v) for k, v in rows if k in gone)


def test_several_columns_and_other_types(spark, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    df = spark.range(2000).selectExpr("id as a", "cast(id % 7 as string) as b")
    keys = spark.range(1000).selectExpr("cast(id * 2 as int) as a", "cast(id * 2 % 7 as string) as b")
    assert drop_keys(df, keys, ["a", "b"]).count() == 1000
    assert drop_keys(df, keys.limit(0), ["a", "b"]).count() == 2000


def test_few_rows_are_hits_by_chance(spark):
    keys = spark.range(0, 100_000, 1).selectExpr("id as k")
    bitmap, bits = bit_map(keys, ["k"], 100_000)
    flagged = marked(spark.range(0, 400_000).selectExpr("id as k"), ["k"], bitmap, bits, "hit")
    hits = {r["own"]: r["hits"] for r in flagged.selectExpr("k < 100000 as own", "hit").groupBy("own").agg({"hit": "count_if"}).toDF("own", "hits").collect()}
    assert hits[True] == 100_000 and hits[False] < 300_000 / 7


def test_rows_that_miss_the_bits_are_not_moved(spark, monkeypatch):
    """Beyond the limit the only exchange of wide rows lies behind the sieve, which lets hits through."""
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    wide = materialise(spark.range(50_000).selectExpr("id as k", "repeat('x', 50) as html"), "wide")
    keys = materialise(spark.range(100).selectExpr("id as k"), "keys")
    flagged = joins._sifted(wide, keys, "k")

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    assert "Exchange hashpartitioning" not in plan(flagged)
    assert flagged.filter(joins.SIEVE).count() < 1000
    dropped = plan(drop_keys(wide, keys, "k"))
    assert "Union" in dropped and dropped.count("Exchange hashpartitioning(k") <= 2
