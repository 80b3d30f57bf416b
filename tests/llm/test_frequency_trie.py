"""Spelling variants against comparison of all words."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cardmill.llm import frequency_trie, queries
from cardmill.llm.frequency_trie import corpus_words, group_variants, near_words, one_apart
from cardmill.session import materialise


def plain_words(rows):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            check = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if check % 31 == 0:
                run = run[: check % len(run)] + run[check % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {word: n for word, n in counts.items() if n >= 2}


def shortened(word):
    return {word[:k] + word[k + 1 :] for k in range(len(word))}


def plain_near(words):
    """Words that are equal after one deletion on one side, or the same one on both."""
    near = defaultdict(set)
    holes = defaultdict(set)
    for word in words:
        for k in range(len(word)):
            holes[word[:k], word[k + 1 :]].add(word)
        for less in shortened(word) & set(words):
            near[word].add(less)
            near[less].add(word)
    for group in holes.values():
        for word in group:
            near[word] |= group - {word}
    return near


def plain_groups(counts):
    near = plain_near(counts)
    form = {}
    for word, n in counts.items():
        if near[word]:
            best = min(near[word], key=lambda other: (-counts[other], other))
            if counts[best] >= 10 * n:
                form[word] = best

    def root(word):
        while word in form:
            word = form[word]
        return word

    return Counter(
        (word, form.get(word), root(word), n, len(near[word]), counts[form[word]] if word in form else None)
        for word, n in counts.items()
    )


def invented(chance, count, letters="abcdeé", low=1, high=9):
    """Words that are often one letter apart."""
    words = {"".join(chance.choices(letters, k=chance.randrange(low, high))) for _ in range(count)}
    for word in list(words)[: count // 2]:
        k = chance.randrange(len(word))
        words.add(word[:k] + chance.choice(letters) + word[k + chance.randrange(2) :])
    return sorted(words)


@pytest.mark.parametrize("node, states, letters", [(50_000, 1 << 18, 1 << 22), (5, 3, 10), (1, 1, 1)])
@pytest.mark.parametrize("groups", [1, 3, 24])
def test_near_words(spark, monkeypatch, node, states, letters, groups):
    monkeypatch.setattr(frequency_trie, "NODE", node)
    monkeypatch.setattr(frequency_trie, "STATES", states)
    monkeypatch.setattr(frequency_trie, "LETTERS", letters)
    words = invented(random.Random(node + groups), 120)
    table = spark.createDataFrame([(word, k + 1) for k, word in enumerate(words)], "word string, n long").repartition(3)
    found = near_words(materialise(table, "words"), groups).collect()
    size = {word: k + 1 for k, word in enumerate(words)}
    assert all(r["n"] == size[r["word"]] and r["other_n"] == size[r["other"]] for r in found)
    pairs = [frozenset((r["word"], r["other"])) for r in found]
    wanted = {frozenset((word, other)) for word, others in plain_near(words).items() for other in others}
    assert len(pairs) == len(set(pairs)) and set(pairs) == wanted and len(wanted) > 50


def test_one_apart():
    def row(word):
        return np.array([[ord(c) for c in word]])

    for one, other, near in (("abc", "abd", True), ("abc", "abc", False), ("abc", "acb", False), ("abc", "xabc", True),
                             ("abc", "abcx", True), ("aaa", "aaaa", True), ("abc", "axbx", False), ("abc", "abbc", True)):
        assert one_apart(row(one), row(other))[0] == near


def test_many_equal_letters(spark):
    """Counts above a byte, letters beyond the basic plane, one letter only."""
    words = ["a" * n for n in (1, 2, 254, 255, 256, 257, 512, 700)] + ["a" * 255 + "b", "\U0001f600a", "\U0001f600", "b" * 700]
    table = materialise(spark.createDataFrame([(word, 1) for word in words], "word string, n long"), "words")
    found = {frozenset((r["word"], r["other"])) for r in near_words(table).collect()}
    assert found == {frozenset((word, other)) for word, others in plain_near(words).items() for other in others}


def documents():
    chance = random.Random(6)
    common = ["Question", "réponses", "answering", "language", "sprachen", "ÜBERSICHT", "×÷×÷×÷×÷"]
    rows = []
    for key in range(400):
        own = chance.choices(common, k=40) + chance.choices(["Langauge", "languages", "langage", "short", "x1answering", "a" * 30], k=4)
        rows.append((key, chance.choice([" ", "\n", "-"]).join(own)))
    rows += [(None, "Question question answering"), (None, "Question"), (7, "language language"), (7, "language language"), (900, None), (901, ""), (902, "longer" * 3000 + " " + "longer" * 3000)]
    return rows


def test_words(spark):
    rows = documents()
    docs = spark.createDataFrame([(*row, "x", 1) for row in rows], "doc_id long, text string, word string, n int").repartition(3)
    wanted = plain_words(rows)
    assert {r["word"]: r["n"] for r in corpus_words(docs).collect()} == wanted
    assert "language" in wanted and any(word in wanted for word in shortened("question"))


def test_query(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    result = queries.op13_frequency_trie(spark, str(tmp_path))
    assert result.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert Counter(map(tuple, result.collect())) == plain_groups(plain_words(rows))


def test_long_ways_and_ties(spark):
    """Forms of forms of forms, and near words that occur equally often."""
    counts = {"abcdefg": 1, "abcdefgh": 10, "abcdefghi": 100, "abcdefghij": 1000, "abcdefghijk": 10_000, "abcdefghijkl": 100_000}
    counts |= {"tiesare": 1, "tiesara": 10, "tiesarb": 10, "nearlyso": 9, "nearlyto": 89, "alonewords": 3}
    chance = random.Random(1)
    counts |= {word: 10 ** chance.randrange(5) for word in invented(chance, 200, "abc", 3, 8)}
    found = group_variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()
    assert Counter(map(tuple, found)) == plain_groups(counts)
    assert {r["word"]: r["root"] for r in found}["abcdefg"] == "abcdefghijkl"


def test_no_words(spark, tmp_path):
    for k, rows in enumerate(([], [(1, None), (2, "few short ones")])):
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/{k}/documents.parquet")
        assert queries.op13_frequency_trie(spark, f"{tmp_path}/{k}").collect() == []
