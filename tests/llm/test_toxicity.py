"""Toxicity: held-out accuracy, and the cases that have no model."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardmill.llm.toxicity import FEATURES, Marks, entries, fit_toxicity, fold


@pytest.fixture(scope="module")
def corpus(spark):
    chance = random.Random(4)
    plain = [f"{a}{b}{c}" for a in ("mo", "ta", "ki") for b in ("ren", "lus", "pid", "gar") for c in ("a", "et", "or", "in", "us")]
    rows, labels = [], []
    for i in range(1500):
        words, toxic = [chance.choice(plain) for _ in range(chance.randint(5, 80))], i % 4 == 0
        for _ in range(chance.randint(1, 3) if toxic else 0):
            words[chance.randrange(len(words))] = chance.choice(["nastyword", "Vilethings", "grubb" + chance.choice(plain)])
        rows.append((i, " ".join(words), "x", 0.5))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, features string, raw double")
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(corpus):
    docs, labels = corpus
    model = fit_toxicity(docs, labels)
    scored = model.score(docs)
    assert scored.columns == [*docs.columns, "toxicity"]
    kept = scored.filter(fold(F.col("doc_id")) == 0).join(labels, "doc_id").collect()
    right = sum((row["toxicity"] >= 0.5) == bool(row["toxic"]) for row in kept)
    assert len(kept) > 200 and right / len(kept) > 0.97
    assert all(0 <= row["toxicity"] <= 1 for row in kept)
    more = [(9001, None), (9002, ""), (9003, "you are a n4styw0rd"), (9004, "word " * 200_000), (None, "grubbxyz grubbzyx you")]
    more = model.score(docs.sparkSession.createDataFrame(more, "doc_id long, text string")).collect()
    score = {row["doc_id"]: row["toxicity"] for row in more}
    assert score[None] >= 0.5 > max(score[9001], score[9002], score[9004])


def test_labels_that_say_nothing(spark, corpus):
    docs, labels = corpus
    empty = fit_toxicity(docs, labels.limit(0))
    assert {row["toxicity"] for row in empty.score(docs).collect()} == {0.0}
    clean = fit_toxicity(docs, labels.withColumn("toxic", F.lit(0)))
    assert {row["toxicity"] for row in clean.score(docs).collect()} == {0.0}
    odd = spark.createDataFrame([(None, 1), (3, None), (4, 1), (4, 0), (4, 1)], "doc_id long, toxic int")
    assert fit_toxicity(docs, odd).trees is None
    assert fit_toxicity(docs.limit(0), labels).score(docs.limit(0)).collect() == []


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    kept = fit_toxicity(docs, labels).score(docs).filter(fold(F.col("doc_id")) == 0).join(labels, "doc_id").collect()
    found = [(row["toxicity"] >= 0.5, row["toxic"] == 1) for row in kept]
    hits, false = sum(a and b for a, b in found), sum(a and not b for a, b in found)
    assert hits >= 0.85 * sum(b for _, b in found)
    assert false <= 0.01 * len(found)


def test_fold_is_the_checksum(spark):
    ids = [0, 1, 17, 123456789, -5]
    got = [row[0] for row in spark.createDataFrame([(i,) for i in ids], "i long").select(fold(F.col("i"))).collect()]
    assert got == [zlib.crc32(str(i).encode()) % 5 for i in ids]


def test_marks():
    marks = Marks({"idiot": 3.0, "mor*": 1.0, "stup*": 2.0})
    assert entries("stupid") == ["stupid", "stup*", "stupi*"]
    kinds = {token: (marks.weight[marks[token]], marks.flags[marks[token]]) for token in
             ["idiot,", "1d10t", "i.d.i.o.t", "stuuuupid!", "You", "LOUD", "it's", "2024", "e-mail", "idiot/fool", "!!!"]}
    assert kinds["idiot,"] == (3.0, 0) and kinds["1d10t"] == (3.0, 3) and kinds["i.d.i.o.t"] == (3.0, 3)
    assert kinds["stuuuupid!"][0] == 2.0 and kinds["You"] == (0.0, 4) and kinds["LOUD"] == (0.0, 8)
    assert kinds["2024"] == (0.0, 0) and kinds["idiot/fool"][0] == 3.0 and kinds["!!!"] == (0.0, 0)
    assert marks.features("") == [0.0] * len(FEATURES)
    assert marks.features("you a a idiot a a a a you")[5] == 1.0


def small(spark):
    chance = random.Random(8)
    words = [f"{a}{b}" for a in ("mo", "ta", "ki", "du") for b in ("ren", "lus", "pid")]
    rows = []
    for i in range(900):
        own = [chance.choice(words) for _ in range(chance.randint(8, 30))] + chance.choices(["grubby", "vilely"], k=int(i % 3 == 0))
        rows.append((i, " ".join(own)))
    rows += [(2000 + i, rows[i][1]) for i in range(0, 200, 2)]  # copies
    labels = [(i, int("grubby" in text or "vilely" in text)) for i, text in rows]
    return rows, labels


def test_scores_do_not_depend_on_partitions(spark):
    rows, labels = small(spark)
    found = []
    for parts in (1, 3, 9):
        chance = random.Random(parts)
        docs = spark.createDataFrame(chance.sample(rows, len(rows)), "doc_id long, text string").repartition(parts)
        marks = spark.createDataFrame(chance.sample(labels, len(labels)), "doc_id long, toxic int").repartition(parts)
        found.append({r["doc_id"]: r["toxicity"] for r in fit_toxicity(docs, marks).score(docs).collect()})
    assert found[0] == found[1] == found[2]
    # Equal texts have equal scores.
    assert all(found[0][2000 + i] == found[0][i] for i in range(0, 200, 2))


def test_scores_from_the_trees_by_hand(spark):
    """Every score from its features by walking the fitted trees and the isotonic steps in plain Python."""
    rows, labels = small(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = fit_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    trees = [tree._call_java("rootNode") for tree in model.trees.trees]
    bounds, steps = list(model.scale.boundaries), list(model.scale.predictions)

    def leaf(node, values):
        while hasattr(node, "split") and node.numDescendants() > 0:
            split = node.split()
            node = node.leftChild() if values[split.featureIndex()] <= split.threshold() else node.rightChild()
        return node.prediction()

    marks = Marks(model.lexicon)
    scored = {r["doc_id"]: r["toxicity"] for r in model.score(docs).collect()}
    for key, text in rows[::60]:
        values = marks.features(text)
        margin = sum(weight * leaf(node, values) for weight, node in zip(model.trees.treeWeights, trees, strict=True))
        raw = 1 / (1 + math.exp(-2 * margin))
        calibrated = float(np.interp(raw, bounds, steps))
        assert scored[key] == pytest.approx(0.999 * calibrated + 0.001 * raw, abs=1e-9)


def test_columns_of_the_documents_stay(spark):
    rows, labels = small(spark)
    docs = spark.createDataFrame([(*row, 7.0, "f") for row in rows], "doc_id long, text string, toxicity double, features string")
    model = fit_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    scored = model.score(docs, name="__toxicity")
    assert scored.columns == [*docs.columns, "__toxicity"]
    assert scored.select("toxicity", "features").distinct().collect() == [(7.0, "f")]
    assert model.score(docs, ["doc_id"]).columns == ["doc_id", "toxicity"]
