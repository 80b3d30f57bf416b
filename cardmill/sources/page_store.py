"""A snapshot of fetched pages from which single pages can be taken.

Rows are attempts to fetch an URL. They lie in shards by the hash of the URL, so a look-up
of few URLs reads the files of their shards only, and HTML of the others is not touched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import joins
from ..session import materialise

#: Pages of a shard, and the largest number of shards: a folder is made for each.
SHARD_PAGES, MOST_SHARDS = 2000, 10_000

LOG = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("attempt", T.IntegerType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("net_error", T.StringType()),
    ]
)


def as_log(pages: DataFrame) -> DataFrame:
    """Stored pages as a log of one answer each."""
    none = F.lit(None).cast("string")
    return pages.select(
        "url", F.lit(1).alias("attempt"), F.lit(200).alias("status"), none.alias("content_type"),
        F.col("html").alias("body"), none.alias("net_error"),
    )


def _shard(url: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(shards)).cast("int")


@dataclass(frozen=True)
class PageStore:
    spark: SparkSession
    path: str
    shards: int

    def rows(self) -> DataFrame:
        schema = T.StructType([*LOG.fields, T.StructField("shard", T.IntegerType())])
        return self.spark.read.schema(schema).parquet(f"{self.path}/log")

    def attempts(self, urls: DataFrame) -> DataFrame:
        """The log of the URLs of a written table ``url``; only their shards are read."""
        keys = urls.select("url").distinct()
        facts = keys.agg(
            F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("url")), F.lit(0)).alias("bytes"),
            F.collect_set(_shard(F.col("url"), self.shards)).alias("shards"),  # MOST_SHARDS at most
        ).first()
        rows = self.rows().filter(F.col("shard").isin(facts["shards"])).drop("shard")
        if facts["rows"] <= joins.BROADCAST_ROWS and facts["bytes"] <= joins.BROADCAST_BYTES:
            return rows.join(F.broadcast(keys), "url", "left_semi")
        return joins.keep_keys(rows, materialise(keys, "keys"), "url")


def write_store(log: DataFrame, path: str, shards: int | None = None) -> PageStore:
    """Store a fetch log (``as_log`` for pages); the one time that HTML is dealt out anew."""
    spark = log.sparkSession
    log = log.select(*(F.col(field.name).cast(field.dataType).alias(field.name) for field in LOG.fields))
    if shards is None:
        shards = min(max(log.count() // SHARD_PAGES, 1), MOST_SHARDS)
    sharded = log.withColumn("shard", _shard(F.col("url"), shards))
    sharded.repartition("shard").write.partitionBy("shard").parquet(f"{path}/log")
    spark.createDataFrame([(shards,)], "shards int").coalesce(1).write.json(f"{path}/about")
    return PageStore(spark, path, shards)


def open_store(spark: SparkSession, path: str) -> PageStore:
    """A store written before."""
    return PageStore(spark, path, spark.read.schema("shards int").json(f"{path}/about").first()["shards"])
