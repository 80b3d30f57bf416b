"""Packing: pieces, plans against exact optima, sequences that give the documents back."""

import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from cardmill.llm import bin_slack, queries
from cardmill.llm.bin_slack import cut_pieces, fullest, pack, plan, sequences
from cardmill.session import materialise


def best(counts, room):
    """The most tokens that fit, by trying all choices."""
    ranges = [range(min(n, room // length) + 1) for length, n in counts.items()]
    totals = (sum(k * length for k, length in zip(own, counts, strict=True)) for own in itertools.product(*ranges))
    return max((total for total in totals if total <= room), default=0)


def test_fullest_is_the_fullest():
    chance = random.Random(4)
    for _ in range(300):
        counts = {chance.randrange(1, 30): chance.randrange(1, 4) for _ in range(chance.randrange(6))}
        room = chance.randrange(0, 60)
        chosen = fullest(counts, room)
        assert all(n <= counts[length] for length, n in chosen.items())
        assert sum(length * n for length, n in chosen.items()) == best(counts, room)


@pytest.mark.parametrize("seed", range(5))
def test_plan_uses_every_piece_once(seed):
    chance = random.Random(seed)
    counts = Counter(min(int(chance.expovariate(1 / 300)) + 1, 2048) for _ in range(5000))
    steps = plan(dict(counts))
    used = Counter()
    for copies, chosen in steps:
        assert copies > 0 and sum(length * n for length, n in chosen.items()) <= 2048
        used.update({length: copies * n for length, n in chosen.items()})
    assert used == counts
    fewest = -(-sum(length * n for length, n in counts.items()) // 2048)
    assert sum(copies for copies, _ in steps) <= fewest + 1


def test_plan_does_not_grow_with_the_corpus():
    counts = {length: 3_000_000_000 // length for length in range(1, 2049)}
    steps = plan(counts)
    assert len(steps) < 2 * 2048
    assert all(len(chosen) < 64 for _, chosen in steps)


def test_plan_of_awkward_lengths():
    assert plan({}) == []
    assert sum(copies for copies, _ in plan({1025: 7})) == 7
    assert sum(copies for copies, _ in plan({2048: 3, 1: 4096})) == 5
    # Largest first alone would take 3: 6 + 3, 5 + 4, 2 (capacity 10).
    assert sum(copies for copies, _ in plan({6: 1, 5: 1, 4: 1, 3: 1, 2: 1}, 10)) == 2


def check(spark, rows, capacity, found, library):
    """Rows ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` against the library's ids."""
    wanted = Counter()
    for key, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) - (len(ids) - 1) // capacity * capacity
        edges = [0, *range(first, len(ids) + 1, capacity)]
        wanted.update(
            (key, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(itertools.pairwise(edges))
        )
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == wanted
    held = defaultdict(list)
    for r in found:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in held.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def documents():
    chance = random.Random(2)
    words = ["alpha", "beta", "Gämma", "1234", "\n", "  ", "don't", "<|endoftext|>", "東京"]
    rows = [(k, " ".join(chance.choices(words, k=chance.choice([0, 1, 5, 40, 300])))) for k in range(150)]
    rows += [(None, "no id"), (None, "no id"), (3, "again"), (3, "again"), (500, None), (501, ""), (502, "long word " * 9000)]
    return rows


def test_query(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bin_slack, "BUCKET", 7)
    library = Tokenizer.from_file(bin_slack.TOKENIZER)
    rows = documents()
    docs = spark.createDataFrame([(*row, 1, "x") for row in rows], "doc_id long, text string, length int, ids string")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op11_bin_slack(spark, str(tmp_path)).collect()
    used = check(spark, rows, 2048, found, library)
    assert used <= best_fit([r["length"] for r in found], 2048)


def best_fit(lengths, capacity):
    """Sequences that best fit needs, longest pieces first."""
    rooms = []
    for length in sorted(lengths, reverse=True):
        rooms.sort()
        at = next((k for k, room in enumerate(rooms) if room >= length), None)
        if at is None:
            rooms.append(capacity - length)
        else:
            rooms[at] -= length
    return len(rooms)


def test_sequences_give_the_documents_back(spark, monkeypatch):
    monkeypatch.setattr(bin_slack, "BUCKET", 3)
    rows = [(k, text) for k, (_, text) in enumerate(documents())]
    pieces = cut_pieces(spark.createDataFrame(rows, "doc_id long, text string"), capacity=64)
    places = materialise(pack(pieces, 64), "places")
    data = {r["sequence_id"]: bytes(r["ids"]) for r in sequences(pieces, places).collect()}
    assert all(len(own) <= 256 for own in data.values())
    parts = defaultdict(dict)
    for r in pieces.join(places, "row").collect():
        at = 4 * r["offset"]
        parts[r["doc_id"]][r["piece"]] = data[r["sequence_id"]][at : at + 4 * r["length"]]
    library = Tokenizer.from_file(bin_slack.TOKENIZER)
    for key, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert b"".join(parts[key][k] for k in sorted(parts[key])) == ids.tobytes()


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    result = queries.op11_bin_slack(spark, str(tmp_path))
    assert result.collect() == []
    assert result.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
