"""Near-duplicates against comparing all pairs."""

import random

import duckdb
import numpy as np
import pytest

from cardmill.llm.components import connected_components
from cardmill.operators import joins
from cardmill.llm.minmax_dedup import near_duplicates, without_duplicates
from cardmill.llm.shingles import shingle_sets, word_hashes

from . import plain

SCHEMA = "doc_id long, text string, component_id string, key string, id string"


def rows_of(texts):
    return [(i, text, "x", "y", "z") for i, text in enumerate(texts)]


def check(spark, texts):
    found = near_duplicates(spark.createDataFrame(rows_of(texts), SCHEMA).repartition(4)).collect()
    wanted = plain.near_duplicates(list(enumerate(texts)))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == wanted
    assert len(found) == len(texts) and all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def edited(chance, text, edits):
    own = text.split(" ")
    for _ in range(edits):
        own[chance.randrange(len(own))] = f"new{chance.randrange(10**9)}"
    return " ".join(own)


def test_edges_of_the_data(spark):
    long = " ".join(f"w{i % 7919}" for i in range(300_000))
    check(spark, [None, "", " \t\n\x0b\x0c\r", "a b c", "A  b\nC", "a b c d", "a b c d e", "É b c d e", "é b c d e", long, long + " x",
                  "x" * 3_000_000, "a b c", "a\xa0b c", "a b c d e f g h", "A B C D E F G H"])


def test_groups_chains_and_passages(spark):
    chance = random.Random(9)
    new = lambda n: " ".join(f"t{chance.randrange(10**6)}" for _ in range(n))
    texts, base, passage = [], new(150), new(70)
    texts += [edited(chance, base, chance.randint(0, 6)) for _ in range(300)]
    texts += [base.upper()] * 30
    step = new(120)
    for _ in range(25):
        texts.append(step)
        step = edited(chance, step, 2)
    texts += [f"{passage} {new(chance.randint(10, 90))}" for _ in range(200)]
    texts += [new(chance.randint(0, 12)) for _ in range(50)]
    chance.shuffle(texts)
    check(spark, texts)


def test_table(spark):
    rows = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(docs).collect()}
    assert found == plain.near_duplicates(rows)


def test_null_and_repeated_ids(spark):
    text = "one two three four five six seven"
    rows = [(None, text), (None, text), (4, text), (4, text), (9, text), (7, "p q r s t u"), (7, "h i j k l"), (8, "h i j k l"),
            (5, "p q r s t u"), (3, None), (None, None)]
    docs = spark.createDataFrame([(*row, "", "", "") for row in rows], SCHEMA)
    found = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(docs).collect()), key=str)
    assert found == sorted([
        (None, 3, None, True), (None, 3, None, True), (4, 3, 4, True), (4, 3, 4, True), (9, 3, 4, False), (7, 2, 5, False),
        (7, 1, 5, False), (8, 1, 5, False), (5, 2, 5, True), (3, 0, 3, True), (None, 0, None, True),
    ], key=str)
    kept = without_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([4, 5, 3], key=str)
    assert near_duplicates(docs.limit(0)).collect() == []


@pytest.mark.parametrize("rows_sent", [200_000, 0])
def test_one_of_equal_rows_stays(spark, monkeypatch, rows_sent):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", rows_sent)
    rows = [(None, "only here"), (None, "only here"), (None, "twice with an id"), (6, "twice with an id"), (None, None), (None, ""), (2, "a"), (2, "a"), (2, "b")]
    docs = spark.createDataFrame([(*row, "", "", "") for row in rows], SCHEMA)
    kept = sorted(((r["doc_id"], r["text"] or "") for r in without_duplicates(docs).collect()), key=str)
    assert kept == sorted([(None, "only here"), (None, ""), (6, "twice with an id"), (2, "a"), (2, "b")], key=str)


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    chance = random.Random(seed)
    links = [(chance.randrange(200), chance.randrange(200)) for _ in range(90)] + [(i, i + 1) for i in range(300, 340)]
    links += [(500, i) for i in range(400, 500)]
    found = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    ids = {i for a, b in links if a != b for i in (a, b)}
    assert sorted(map(tuple, found)) == sorted(plain.components(ids, [link for link in links]).items()) or {
        r["id"]: r["component"] for r in found
    } == plain.components(ids, [link for link in links if link[0] != link[1]])


def test_hashes_follow_words():
    texts = ["", "A b", "a  B ", "x " * 700_000, "y" * 2_500_000 + " z", "é É"]
    for text in texts:
        hashes, places = word_hashes(text.encode())
        own = plain.words(text)
        assert len(hashes) == len(own) == len(places)
        assert len(set(hashes.tolist())) == len(set(own))
    one, two = shingle_sets([b"A b c", b"q a B c"])
    assert len(one) == len(two) == 1 and not np.intersect1d(one, two).size


def test_large_group_that_is_not_alike_enough(spark, monkeypatch):
    monkeypatch.setattr("cardmill.llm.minmax_dedup.PAIRS_EACH", 0)
    chance = random.Random(12)
    base = " ".join(f"b{chance.randrange(10**6)}" for _ in range(140))
    check(spark, [edited(chance, base, chance.randint(0, 30)) for _ in range(250)] + [base] * 5)
