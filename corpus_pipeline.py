"""From raw documents to token ids: four stages and their run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardmill.llm.arrow import table
from cardmill.llm.bitmap_bpe import encode_bpe
from cardmill.llm.minmax_dedup import without_duplicates
from cardmill.llm.mixing import copies_of, label_weight, mix
from cardmill.llm.toxicity import fit_toxicity
from cardmill.session import materialise

TOXIC = 0.5


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, learned from ``labels``, does not find toxic."""
    scored = fit_toxicity(docs, table(spark, sf_dir, "labels")).score(docs, name="__toxicity")
    return scored.filter(F.col("__toxicity") < TOXIC).drop("__toxicity")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of every group of near-duplicates."""
    return without_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the target weights of the sources ask for; quality labels weigh the draw."""
    weighted, weight = label_weight(docs, table(spark, sf_dir, "labels"))
    return copies_of(mix(weighted, F.col(weight), name="__mix"), "__mix").drop(weight)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every whole text, with the checksum of the bytes that they decode to."""
    decoded = encode_bpe(docs, decoded=True)
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("toxicity", not_toxic),
    ("near_duplicates", distinct),
    ("mixing", mixed),
    ("byte_bpe", encoded),
]

#: A trained model and hashed signatures decide: SQL has no words for them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
