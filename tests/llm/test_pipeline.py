"""The pipeline against its stages' rules, one by one."""

import hashlib
from collections import Counter

import duckdb

import corpus_pipeline
from cardmill.llm.toxicity import fit_toxicity

from . import plain

FOLDER = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall())
    kept = [texts]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.columns
        out = stage(spark, docs, FOLDER)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if k < 3:
            assert docs.columns == before
            rows = docs.select("doc_id", "text").collect()
            assert all(row["text"] == texts[row["doc_id"]] for row in rows)
            kept.append(Counter(row["doc_id"] for row in rows))
    model = fit_toxicity(spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet"))
    scored = model.score(spark.read.parquet(f"{FOLDER}/documents.parquet")).collect()
    assert set(kept[1]) == {row["doc_id"] for row in scored if row["toxicity"] < 0.5}
    groups = plain.near_duplicates([(i, texts[i]) for i in kept[1]])
    assert kept[2] == Counter(i for i, (_, component) in groups.items() if i == component)
    sizes = {i: len(plain.words(texts[i])) for i in kept[2]}
    total = sum(sizes.values())
    assert abs(sum(sizes[i] * n for i, n in kept[3].items()) - total) < 0.1 * total
    assert max(kept[3].values()) <= 3
    found = docs.collect()
    assert Counter(row["doc_id"] for row in found) == kept[3]
    assert all(row["decoded_sha256"] == hashlib.sha256(texts[row["doc_id"]].encode()).hexdigest() for row in found)


def test_no_documents(spark, tmp_path):
    spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{FOLDER}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_columns_of_the_documents_stay(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    more = docs.selectExpr("*", "1.5D as toxicity", "'m' as mix", "doc_id as features", "'w' as weight")
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, more, "/root/testdata/sf0.001")
        assert out.columns == more.columns
        assert out.select("toxicity", "mix", "weight").distinct().collect() == [(1.5, "m", "w")]
