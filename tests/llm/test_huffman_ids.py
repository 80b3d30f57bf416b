"""Id files: exact round trips, and the library's ids."""

import heapq
import itertools
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from cardmill.llm import huffman_ids, queries
from cardmill.llm.huffman_ids import STEP, Codec, code_lengths, library_ids, read_ids, write_ids
from cardmill.session import new_dir

from .test_bpe import TEXTS


def huffman_size(counts):
    heap = [int(c) for c in counts if c]
    heapq.heapify(heap)
    total = 0
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        total += both
        heapq.heappush(heap, both)
    return total


@pytest.mark.parametrize("size, limit", [(2, 16), (7, 3), (300, 9), (300, 30), (5000, 13), (5000, 30)])
def test_lengths_are_a_code(size, limit):
    counts = (1e6 / np.arange(1, size + 1) ** 1.5 + 1).astype(np.int64)
    np.random.default_rng(size).shuffle(counts)
    lengths = code_lengths(counts, limit).astype(int)
    assert lengths.min() >= 1 and lengths.max() <= limit
    assert (0.5**lengths).sum() == 1
    assert (counts * lengths).sum() >= huffman_size(counts)
    if limit >= 30 or size == 2:
        assert (counts * lengths).sum() == huffman_size(counts)


def test_limited_lengths_are_best():
    counts = np.array([1, 1, 2, 3, 90, 400])
    best = min(
        sum(c * l for c, l in zip(counts, own, strict=True))
        for own in itertools.product(range(1, 4), repeat=6) if sum(0.5**l for l in own) <= 1
    )
    assert (counts * code_lengths(counts, 3).astype(int)).sum() == best


def test_codec_round_trip():
    chance = np.random.default_rng(2)
    ids = np.minimum(chance.zipf(1.3, 40_000), 9_000).astype(np.uint32)
    offsets = np.array([0, 0, 1, STEP, STEP + 1, 2 * STEP + 1, 9_000, 9_000, 40_000])
    codec = Codec(code_lengths(np.bincount(ids)))
    codes, checks = codec.encode(ids, offsets)
    for code, own, a, b in zip(codes, checks, offsets[:-1], offsets[1:], strict=True):
        bits = np.concatenate([[0], own])
        counts = np.full(len(bits), STEP)
        counts[-1] = b - a - (len(bits) - 1) * STEP
        assert codec.decode(code, bits, counts).tolist() == ids[a:b].tolist()
        # A stretch decodes by itself.
        assert codec.decode(code, bits[-1:], counts[-1:]).tolist() == ids[b - counts[-1] : b].tolist()


def test_files(spark, monkeypatch):
    monkeypatch.setattr(huffman_ids, "BLOCK_BYTES", 200)
    rows = [(i * 31 % 101, text, "x", "y") for i, text in enumerate(TEXTS * 3)] + [(None, "none", "x", "y"), (7, "twice", "x", "y"), (7, "twice", "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string, ids string").repartition(5)
    path = new_dir(spark, "test-ids")
    write_ids(library_ids(docs), path)
    found = sorted(((r["start"], r["doc_id"], r["n_tokens"], bytes(r["ids"])) for r in read_ids(spark, path).collect()), key=lambda r: r[0])
    library = Tokenizer.from_file(huffman_ids.TOKENIZER)
    library.encode_special_tokens = True
    wanted = {}
    for key, text, *_ in rows:
        own = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        wanted.setdefault(key, []).append(zlib.crc32(own))
    got, at = {}, 0
    for start, key, n, ids in found:
        assert start == at and len(ids) == 4 * n
        at += n
        got.setdefault(key, []).append(zlib.crc32(ids))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in wanted.items()}
    keys = [-1 if key is None else key for _, key, _, _ in found]
    assert keys == sorted(keys)


def test_one_and_no_documents(spark):
    for rows in ([], [(5, None)], [(5, "")]):
        path = new_dir(spark, "test-ids")
        write_ids(library_ids(spark.createDataFrame(rows, "doc_id long, text string")), path)
        found = [(r["doc_id"], r["start"], r["n_tokens"], bytes(r["ids"])) for r in read_ids(spark, path).collect()]
        assert found == [(5, 0, 1, b"\x02\0\0\0")] * len(rows)


def test_added_tokens_as_in_the_library(spark, tmp_path):
    token = "<|endoftext|>"
    parts = [token, token, " ", "  ", "\n", "a", " b", "don't", "<|end", "of", "text|>", "é"]
    chance = random.Random(9)
    rows = list(enumerate([*TEXTS, f"a {token} b", token, token * 3, f"x  {token}  y", "plain", *("".join(chance.choices(parts, k=12)) for _ in range(300))]))
    library = Tokenizer.from_file(huffman_ids.TOKENIZER)
    wanted = {key: [*library.encode(text or "", add_special_tokens=False).ids, 2] for key, text in rows}
    assert wanted[len(TEXTS)] == [64, 220, 50256, 275, 2]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = library_ids(docs, added=True).collect()
    assert {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in found} == wanted
    assert all(r["n_tokens"] == len(wanted[r["doc_id"]]) for r in found)
    start = np.cumsum([0] + [len(wanted[key]) for key, _ in rows]).tolist()
    for r in queries.op9_huffman_ids(spark, str(tmp_path)).collect():
        own = wanted[r["doc_id"]]
        assert (r["start"], r["n_tokens"]) == (start[r["doc_id"]], len(own))
        assert r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
