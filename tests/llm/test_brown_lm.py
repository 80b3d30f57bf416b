"""Class-based scores against a plain model, and what they must add up to."""

import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from cardmill.llm import brown_lm
from cardmill.llm.brown_lm import exchange, fit_classes, perplexity, score_texts, word_counts

from . import plain


def held(key):
    return zlib.crc32(b"" if key is None else str(key).encode()) % 10 == 0


def base_scores(rows):
    training = Counter()
    for key, text in rows:
        if not held(key):
            training.update([*plain.words(text), None])
    n, v = sum(training.values()), len(training)
    for key, text in rows:
        tokens = [*plain.words(text), None]
        base = sum(math.log10((training[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)
        yield key, held(key), len(tokens), sum(training[t] > 0 for t in tokens), n, base


def check(spark, rows):
    docs = spark.createDataFrame([(key, text, "x", 1) for key, text in rows], "doc_id long, text string, n string, row int")
    found = sorted(score_texts(docs.repartition(3)).collect(), key=lambda r: (str(r["doc_id"]), r["base_score"]))
    wanted = sorted(base_scores(rows), key=lambda r: (str(r[0]), r[5]))
    assert len(found) == len(wanted)
    for got, want in zip(found, wanted, strict=True):
        assert tuple(got)[:5] == want[:5]
        assert math.isclose(got["base_score"], want[5], rel_tol=1e-9, abs_tol=1e-9)
        assert got["score"] <= 1e-9
    return found


@pytest.mark.parametrize("head", [3, 100_000])
def test_counts_and_base(spark, head, monkeypatch):
    monkeypatch.setattr(brown_lm, "HEAD", head)
    chance = random.Random(1)
    words = ["The", "cat", "É", "é", "sat", "a\xa0b", "mat,", "on", "dog"]
    rows = [(i, " ".join(chance.choices(words, k=chance.randint(0, 30)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, " \t\n"), (503, "new " * 100_000), (None, "the cat"), (7, "twice"), (7, "twice"), (504, "y" * 10**6)]
    check(spark, rows)


def test_no_training_and_no_rows(spark):
    assert check(spark, [(None, "a b c"), (None, None)])[0]["score"] == 0.0
    assert check(spark, []) == []


def test_probabilities_add_up(spark, monkeypatch):
    monkeypatch.setattr(brown_lm, "WORDS", 6)
    monkeypatch.setattr(brown_lm, "ENDINGS", 4)
    monkeypatch.setattr(brown_lm, "TYPES", 12)
    monkeypatch.setattr(brown_lm, "CLASSES", 5)
    chance = random.Random(3)
    texts = [" ".join(f"w{min(int(chance.expovariate(0.2)), 30)}" for _ in range(20)) for _ in range(40)]
    training = spark.createDataFrame([(t,) for t in texts], "text string")
    counts = word_counts(training)
    model = fit_classes(training, counts, len(texts))
    types = brown_lm.Types(model.words, model.endings)
    n = {bytes(r["word"]): r["n"] for r in counts.collect()}
    for before in range(5):
        total = sum(10 ** model.step[before, model.classes[types.of(brown_lm.Line([w]))[0]]] * (c + 0.1) for w, c in n.items())
        total += 10 ** model.step[before, 0] * (model.ends + 0.1)
        total += sum(10 ** model.step[before, k] * 0.1 for k in range(1, 5))
        assert math.isclose(total, 1, rel_tol=1e-2)
        assert total <= 1 + 1e-9


def test_exchange_finds_kinds():
    chance = np.random.default_rng(0)
    kind = chance.integers(0, 3, 61)
    kind[0] = 0
    often = np.array([[0, 9, 1], [1, 0, 9], [9, 1, 0]])[kind[:, None], kind[None, :]]
    bigrams = chance.poisson(often * 3.0).astype(float)
    bigrams[0] = bigrams[:, 0] = 0
    own = exchange(bigrams, 4, 20)
    for k in range(3):
        members = own[1:][kind[1:] == k]
        assert len(set(members.tolist())) == 1


def test_beats_the_base_on_held_out_texts(spark):
    rows = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    scored = score_texts(docs)
    assert {r["doc_id"]: r["n_known"] for r in scored.collect()} == {r[0]: r[3] for r in base_scores(rows)}
    found = {r["held_out"]: r for r in perplexity(scored).collect()}
    assert found[True]["perplexity"] < 0.8 * found[True]["base_perplexity"]


def test_clustered_words_follow_the_vocabulary(spark, monkeypatch):
    for name, value in {"WORDS": 6, "ENDINGS": 4, "TYPES": 12, "CLASSES": 5, "OFTEN": 10}.items():
        monkeypatch.setattr(brown_lm, name, value)
    chance = random.Random(4)
    # Nouns and verbs in turn, all with the same ending.
    names = [[f"{kind}{k}same" for k in range(40)] for kind in "nv"]
    texts = [" ".join(chance.choice(names[k % 2]) for k in range(40)) for _ in range(100)] + ["seldomsame"]
    training = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    counts = word_counts(training)
    model = fit_classes(training, counts, len(texts))
    often = {bytes(r["word"]) for r in counts.collect() if r["n"] >= 10}
    types = brown_lm.Types(model.words, model.endings)
    assert len(often) == 80 and len(model.words) == len(often) and len(set(types.of(brown_lm.Line(sorted(often))).tolist())) == len(often)
    assert types.of(brown_lm.Line([b"seldomsame"]))[0] < brown_lm.TYPES
    found = [{int(model.classes[types.of(brown_lm.Line([w.encode()]))[0]]) for w in own} for own in names]
    assert not found[0] & found[1]


@pytest.mark.parametrize("often", [3, 10**9])
def test_score_by_hand(spark, monkeypatch, often):
    """Every score from the classes alone: bigrams, class sizes and word shares counted in plain Python."""
    monkeypatch.setattr(brown_lm, "OFTEN", often)
    monkeypatch.setattr(brown_lm, "WORDS", 8)
    monkeypatch.setattr(brown_lm, "ENDINGS", 5)
    monkeypatch.setattr(brown_lm, "TYPES", 15)
    monkeypatch.setattr(brown_lm, "CLASSES", 6)
    monkeypatch.setattr(brown_lm, "HEAD", 5)
    chance = random.Random(11)
    rows = [(i, " ".join(f"w{min(int(chance.expovariate(0.15)), 60)}{chance.choice('abé')}" for _ in range(chance.randrange(25)))) for i in range(90)]
    rows += [(700, "never seen Words"), (701, None), (None, "W1a w2b")]
    own = [text for key, text in rows if not held(key)]
    training = spark.createDataFrame([(text,) for text in own], "text string").repartition(2)
    counts = word_counts(training)
    words = {bytes(r["word"]).decode(): r["n"] for r in counts.collect()}
    assert words == Counter(word for text in own for word in plain.words(text))
    model = fit_classes(training, counts, len(own))

    def kind(word):
        found = model.words.get(word.encode())
        return int(model.classes[model.endings.get(word.encode()[-3:], brown_lm.OTHER) if found is None else found])

    moves, size, kinds = Counter(), Counter(), Counter()
    for text in own:
        line = [0, *map(kind, plain.words(text)), 0]
        moves.update(zip(line, line[1:], strict=False))
    for word, n in words.items():
        size[kind(word)] += n
        kinds[kind(word)] += 1
    total, tokens, vocabulary = sum(moves.values()), sum(words.values()) + len(own), len(words) + 1
    into, out = Counter(), Counter()
    for (a, b), n in moves.items():
        out[a] += n
        into[b] += n

    def chance_of(before, word):
        own_kind = 0 if word is None else kind(word)
        n = len(own) if word is None else words.get(word, 0)
        mass = len(own) + 0.1 if own_kind == 0 else size[own_kind] + 0.1 * (kinds[own_kind] + 1)
        move = (moves[before, own_kind] + 5 * into[own_kind] / total) / (out[before] + 5)
        return 0.95 * move * (n + 0.1) / mass + 0.05 * (n + 0.1) / (tokens + 0.1 * (vocabulary + 5)), own_kind

    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for r in score_texts(docs).collect():
        text = dict(rows)[r["doc_id"]]
        before, score = 0, 0.0
        for word in [*plain.words(text), None]:
            p, before = chance_of(before, word)
            score += math.log10(p)
        assert math.isclose(r["score"], score, rel_tol=1e-9, abs_tol=1e-9)
