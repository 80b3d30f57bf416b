"""Byte-level BPE against the tiktoken library."""

import base64
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from cardmill.llm.bitmap_bpe import RANKS, Merger, RankQueue, decode_bpe, encode_bpe

TEXTS = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "don't we'LL I'm it's", "x  y\n\n z\x1c \x85 end", "　a  b",
    "aaaaaaaaaaaaaaaaaaaaaaaa", "a" * 50_000 + "b", "ab" * 20_000, "élève 12345 №7!?…", "日本語テキスト", "\U0001f600\U0001f600 ok",
    "tab\tand\rreturn\x0b\x0c", "<|endoftext|> stays text", " lead and trail ", "one two  three \n four", "\x00\x01 \x7f",
]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_and_bytes(spark, library):
    rows = [(i, text, "x") for i, text in enumerate(TEXTS)] + [(None, "no id", "x"), (3, "again", "x"), (3, "again", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    encoded = encode_bpe(docs)
    wanted = sorted((-1 if i is None else i, library.encode_ordinary(text or "")) for i, text, _ in rows)
    assert sorted((-1 if i is None else i, ids) for i, ids in encoded.collect()) == wanted
    decoded = decode_bpe(encoded).select(F.coalesce("doc_id", F.lit(-1)), "decoded").collect()
    assert sorted((i, bytes(data)) for i, data in decoded) == sorted((-1 if i is None else i, (text or "").encode()) for i, text, _ in rows)
    both = encode_bpe(docs, decoded=True).select(F.coalesce("doc_id", F.lit(-1)), "ids", "decoded").collect()
    assert sorted((i, ids) for i, ids, _ in both) == wanted and sorted((i, bytes(d)) for i, _, d in both) == sorted((i, bytes(d)) for i, d in decoded)
    assert encode_bpe(docs.limit(0)).collect() == [] == decode_bpe(encoded.limit(0)).collect()


def test_random_strings(library):
    chance = random.Random(5)
    merger = Merger()
    alphabet = "abcdeéèß the ing tion 12 ,.!　漢字"
    tokens = ["".join(chance.choices(alphabet, k=chance.randint(1, 60))) for _ in range(3000)]
    ids, lengths = merger.encode(tokens)
    at = 0
    for token, length in zip(tokens, lengths.tolist(), strict=True):
        assert ids[at : at + length].tolist() == library._encode_single_piece(token)
        at += length


def test_queue_orders_ranks():
    import numpy as np

    queue, chance = RankQueue(50_000), np.random.default_rng(3)
    ranks = chance.integers(0, 50_000, 4000)
    queue.push(ranks, np.arange(4000))
    seen = []
    while (rank := queue.first()) >= 0:
        at = queue.pop(rank)
        assert (ranks[at] == rank).all()
        seen += [rank] * len(at)
    assert seen == sorted(ranks.tolist())
