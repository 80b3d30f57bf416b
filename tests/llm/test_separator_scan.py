"""Separator scans against splitting the whole stream, and against the ids of another operator."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardmill.llm.queries import op2_separator_scan, op7_bpe
from cardmill.llm.separator_scan import END, KIND, scan_separators, token_blocks, write_flat
from cardmill.session import new_dir

from .test_bpe import TEXTS


def split(tokens):
    """Start and length of every document of one long list."""
    found, start = [], 0
    for at, token in enumerate(tokens):
        if token == END:
            found.append((start, at - start, True))
            start = at + 1
    return found + ([(start, len(tokens) - start, False)] if start < len(tokens) else [])


@pytest.mark.parametrize("share", [0.0, 0.02, 0.5, 1.0])
@pytest.mark.parametrize("tail", [[], [7, 7]])
def test_stitching(spark, share, tail):
    chance = random.Random(6)
    files = [[END if chance.random() < share else chance.randrange(100) for _ in range(n)] for n in (0, 50, 1, 0, 333, 64)]
    files[-1] += tail
    rows = []
    for k, tokens in enumerate(files):
        data = np.array(tokens, KIND).tobytes()
        rows += [(f"f{k}", b, data[b * 32 : b * 32 + 32], "x") for b in range(max(1, -(-len(data) // 32)))]
    blocks = spark.createDataFrame(rows, "file string, block int, data binary, tokens string").repartition(4)
    found = sorted(map(tuple, scan_separators(blocks).collect()))
    wanted = split([token for tokens in files for token in tokens])
    assert found == [(k, *document) for k, document in enumerate(wanted)]


def test_files_of_texts(spark):
    docs = spark.createDataFrame([(text, 1) for text in TEXTS], "text string, tokens int").coalesce(1)
    path = new_dir(spark, "test-flat")
    write_flat(docs, path)
    found = sorted(map(tuple, scan_separators(token_blocks(spark, path, 4096)).collect()))
    from cardmill.llm.bitmap_bpe import encode_bpe

    sizes = [len(ids) for _, ids in sorted(encode_bpe(docs.select("text", F.monotonically_increasing_id().alias("doc_id"))).collect())]
    assert [n for _, _, n, _ in found] == sizes and all(ended for *_, ended in found)
    assert [start for _, start, _, _ in found] == [sum(sizes[:k]) + k for k in range(len(sizes))]


def test_no_documents(spark):
    path = new_dir(spark, "test-flat")
    write_flat(spark.createDataFrame([], "text string"), path)
    assert scan_separators(token_blocks(spark, path)).collect() == []
    nulls = spark.createDataFrame([("a", 0, None), ("b", 0, b"")], "file string, block int, data binary")
    assert scan_separators(nulls).collect() == []


def test_table(spark):
    folder = "/root/testdata/sf0.001"
    found = op2_separator_scan(spark, folder).collect()
    assert sorted(r["n_tokens"] for r in found) == sorted(r["n_tokens"] for r in op7_bpe(spark, folder).collect())
    assert sorted(r["doc_no"] for r in found) == list(range(len(found)))


def test_files_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr("cardmill.llm.separator_scan.FILE_BYTES", 5000)
    docs = spark.createDataFrame([("word " * 200,)] * 40, "text string").repartition(1)
    path = new_dir(spark, "bounded")
    write_flat(docs, path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("length").collect()
    assert len(files) >= 20 and all(row["length"] <= 5000 for row in files)
    assert scan_separators(token_blocks(spark, path)).count() == 40
