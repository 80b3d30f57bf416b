"""Alignment of two tokenizers against token by token comparison."""

import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cardmill.llm import coalesced_alignment, queries
from cardmill.llm.coalesced_alignment import align_tokens, alignment_report, coalesce, link_counts, write_aligned

NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def spans(tokens):
    """``(id, start, end)`` of tokens with their bytes."""
    ends = list(itertools.accumulate((len(data) for _, data in tokens), initial=0))
    return [(token, a, b) for (token, _), a, b in zip(tokens, ends, ends[1:], strict=False)]


def plain(rows):
    """What every text has, by comparing all tokens of one side with all of the other."""
    library = Tokenizer.from_file(coalesced_alignment.A)
    library.encode_special_tokens = True
    shown = {char: byte for byte, char in byte_names().items()}
    names = {token: bytes(shown[c] for c in name) for name, token in library.get_vocab(with_added_tokens=False).items() if all(c in shown for c in name)}
    model = sentencepiece.SentencePieceProcessor(model_file=coalesced_alignment.B)

    def piece(token):
        name = model.id_to_piece(token)
        return bytes([int(name[3:5], 16)]) if model.is_byte(token) else name.replace("▁", " ").encode()

    documents = []
    for key, text in rows:
        a = [(token, names[token]) for token in library.encode(" " + text, add_special_tokens=False).ids] if text else []
        b = [(token, piece(token)) for token in model.encode(text)] if text else []
        wanted = (" " + text).encode() if text else b""
        if not text or b"".join(d for _, d in a) != wanted or b"".join(d for _, d in b) != wanted:
            a, b = [], []
        documents.append((key, spans(a), spans(b)))
    counts, links = Counter(), []
    for _, a, b in documents:
        own = [(x, y) for x, s, e in a for y, t, f in b if s < f and t < e]
        links.append(own)
        counts.update(own)
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    result = []
    for (key, a, b), own in zip(documents, links, strict=True):
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups = []
        for low, high in zip([0, *cuts], cuts, strict=False):
            groups.append(tuple(",".join(str(x) for x, s, e in side if low <= s and e <= high) for side in (a, b)))
        shown_groups = ";".join("|".join(group) for group in groups)
        digest = hashlib.sha256(shown_groups.encode()).hexdigest() if a else ""
        best = sum(counts[pair] == most[pair[1]] for pair in own)
        result.append((key, len(a), len(b), len(groups), len(own), best, sum(counts[pair] for pair in own), digest))
    return Counter(result)


def byte_names():
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {byte: chr(byte) for byte in seen}
    names.update({byte: chr(256 + k) for k, byte in enumerate(sorted(set(range(256)) - set(seen)))})
    return names


def documents():
    chance = random.Random(8)
    words = ["strange", "ungewöhnlich", "don't", "  ", "\n", "\t", "12345", "東京", "\U0001f600", "<s>", "<|endoftext|>", "<0x0A>", "x\x00y", "é", "\xa0", "...", "naïveté"]
    rows = [(k, " ".join(chance.choices(words, k=chance.choice([1, 3, 20, 60])))) for k in range(80)]
    rows += [(None, "no id"), (None, None), (3, "again"), (3, "again"), (500, ""), (501, " "), (502, "   "), (503, " a"), (504, "a ")]
    rows += [(505, "changed ▁ text"), (506, "\n"), (507, "longword" * 40), (508, "tail▁")]
    return rows


def test_coalesce_of_random_cuts():
    chance = np.random.default_rng(3)
    for _ in range(200):
        size = int(chance.integers(1, 40))
        sides = []
        for _ in range(2):
            cuts = np.flatnonzero(chance.random(size - 1) < chance.random()) + 1
            sides.append((np.concatenate([[0], cuts]), np.concatenate([cuts, [size]])))
        (a, a_end), (b, b_end) = sides
        steps = coalesce(a, a_end, b, b_end)
        links = list(zip(np.cumsum(steps & 1) - 1, np.cumsum(steps >> 1) - 1, strict=True))
        assert links == sorted((i, j) for i in range(len(a)) for j in range(len(b)) if a[i] < b_end[j] and b[j] < a_end[i])
        assert (steps == 3).sum() == len(set(a_end.tolist()) & set(b_end.tolist()))
    assert coalesce(*[np.zeros(0, np.int64)] * 4).tolist() == []


def test_query(spark, tmp_path):
    rows = documents()
    docs = spark.createDataFrame([(*row, 1, "x") for row in rows], "doc_id long, text string, n_a int, steps string")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    result = queries.op12_coalesced_alignment(spark, str(tmp_path))
    assert result.columns == ["doc_id", *NAMES]
    assert Counter(map(tuple, result.collect())) == plain(rows)


def test_links_that_are_not_sent_to_all_tasks(spark, monkeypatch):
    rows = documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    wanted = plain(rows)
    for hot, counted in ((0, 1), (20, 50)):
        monkeypatch.setattr(coalesced_alignment, "HOT", hot)
        monkeypatch.setattr(coalesced_alignment, "COUNTED", counted)
        monkeypatch.setattr(coalesced_alignment, "TEXT", 100)
        monkeypatch.setattr(coalesced_alignment, "IDS", 100)
        found = alignment_report(write_aligned(align_tokens(docs)))
        assert Counter(map(tuple, found.collect())) == wanted


def test_link_counts(spark):
    aligned = write_aligned(align_tokens(spark.createDataFrame([(1, "a b a"), (2, "a")], "doc_id long, text string")))
    found = {(r["a_id"], r["b_id"]): (r["n"], r["best"]) for r in link_counts(aligned).collect()}
    assert sorted(found.values()) == [(1, True), (3, True)]
    row = aligned.filter("doc_id = 1").first()
    assert len(row["a_ids"]) == len(row["b_ids"]) == 6 and bytes(row["steps"]) == b"\3\3\3"


def test_no_documents_and_no_texts(spark, tmp_path):
    for k, rows in enumerate(([], [(1, None), (2, "")])):
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/{k}/documents.parquet")
        found = queries.op12_coalesced_alignment(spark, f"{tmp_path}/{k}")
        assert sorted(map(tuple, found.collect())) == [(key, 0, 0, 0, 0, 0, 0, "") for key, _ in rows]


def test_one_very_long_text_among_short_ones(spark):
    rows = [(0, "word, Wörter; 17 " * 40_000), *((k, f"short {k}") for k in range(1, 50))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = alignment_report(write_aligned(align_tokens(docs))).filter(F.col("doc_id") == 0).first()
    library = Tokenizer.from_file(coalesced_alignment.A)
    assert found["n_a"] == len(library.encode(" " + rows[0][1], add_special_tokens=False).ids)
