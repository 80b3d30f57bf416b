"""One query per operator over its whole table, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_dir
from .arrow import table
from .bin_slack import cut_pieces, pack
from .bitmap_bpe import encode_bpe
from .minmax_dedup import near_duplicates
from .brown_lm import score_texts
from .coalesced_alignment import align_tokens, alignment_report, write_aligned
from .frequency_trie import corpus_words, group_variants
from .huffman_ids import library_ids, read_ids, write_ids
from .mixing import label_weight, measured, mix
from .rotated_codes import nearest
from .separator_scan import scan_separators, token_blocks, write_flat
from .tiled_cosine import near_vectors
from .toxicity import fit_toxicity, fold
from .wrappers import extract_text

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if oracle is not None:
            ORACLES[function.__name__] = oracle
        return function

    return register


MIX_SQL = """
WITH marks AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
docs AS (
  SELECT d.doc_id, d.source,
    len(regexp_extract_all(coalesce(d.text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    -ln((('0x' || substr(md5('11:' || coalesce(d.doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE + 0.5)
        / 281474976710656.0)
      / (CASE m.quality WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END)::DOUBLE AS key
  FROM documents d LEFT JOIN marks m ON d.doc_id = m.doc_id),
sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    (1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::DOUBLE AS share
  FROM docs GROUP BY source),
filled AS (
  SELECT *, source_size::DOUBLE * 3 AS cap,
    coalesce(sum(source_size::DOUBLE * 3) OVER earlier, 0) AS caps,
    coalesce(sum(share) OVER earlier, 0) AS shares,
    sum(share) OVER () AS all_shares, sum(source_size::DOUBLE) OVER () AS total
  FROM sizes
  WINDOW earlier AS (ORDER BY source_size::DOUBLE * 3 / share, source NULLS LAST
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT *, (total - caps) / (all_shares - shares) AS level FROM filled),
targets AS (
  SELECT source, source_size,
    CASE WHEN cap <= share * level THEN cap
         ELSE share * max(CASE WHEN cap > share * level THEN level END) OVER () END AS target
  FROM levels),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END::BIGINT AS epochs
  FROM targets),
running AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, b.epochs,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id
                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      + d.size / 2.0 < b.target - b.epochs * b.source_size AS fits
  FROM docs d JOIN budgets b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, least(epochs + fits::BIGINT, 3) AS copies,
  least(epochs + fits::BIGINT, 3) * size AS taken
FROM running
"""


@query()
def op1_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@query(MIX_SQL)
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, weight = label_weight(measured(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))
    mixed = mix(docs, F.col(weight))
    return mixed.select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken", "mix.copies")


@query()
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = encode_bpe(table(spark, sf_dir, "documents"), decoded=True)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query()
def op3_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.filter("vec_id % 50 = 0"))


@query()
def op4_tiled_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


@query()
def op9_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_dir(spark, "huffman")
    write_ids(library_ids(table(spark, sf_dir, "documents"), added=True), path)
    return read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query()
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = fit_toxicity(docs, table(spark, sf_dir, "labels")).score(docs, ["doc_id"])
    held_out = (fold(F.col("doc_id")) == 0).alias("held_out")
    return scored.select("doc_id", held_out, F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


@query()
def op6_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


@query()
def op10_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query()
def op2_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_dir(spark, "flat-tokens")
    write_flat(table(spark, sf_dir, "documents"), path)
    return scan_separators(token_blocks(spark, path))


@query()
def op11_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = cut_pieces(table(spark, sf_dir, "documents"))
    own = pieces.select("row", "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"))
    return own.join(pack(pieces), "row").drop("row")


@query()
def op12_coalesced_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_report(write_aligned(align_tokens(table(spark, sf_dir, "documents"))))


@query()
def op13_frequency_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(corpus_words(table(spark, sf_dir, "documents").select("doc_id", "text")))
