"""Stored pages and crawl seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import strip
from ..operators.joins import drop_keys, fits_broadcast, keep_keys
from ..operators.rules import MODES
from ..session import materialise

PAGES = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spread(spark.read.schema(PAGES).parquet(path))


def spread(scan: DataFrame) -> DataFrame:
    """Give the work on a freshly scanned table enough tasks.

    A large table already scans in many splits and is left alone, so HTML is
    never shuffled; only a table of few row groups is dealt out to the cores.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def latest_pages(pages: DataFrame) -> DataFrame:
    """The newest copy (highest ``page_id``) of every URL, exactly one.

    Works on the two key columns and drops the outdated copies by key, so HTML is not
    shuffled. Only URLs whose newest ``page_id`` occurs twice or has no number are set
    aside: of their copies the first one in order of the HTML's hash stays. Pages without
    a URL are nobody's copies and all stay.
    """
    newest = pages.filter("url is not null").groupBy("url").agg(
        F.max("page_id").alias("newest"), F.count("*").alias("copies"), F.count("page_id").alias("numbered")
    )
    repeated = materialise(newest.filter("copies > 1"), "repeated")
    keys = pages.select("url", "page_id").join(repeated.select("url", "newest", "numbered", "copies"), "url")
    tops = keys.groupBy("url").agg(F.sum(F.when(F.col("page_id") == F.col("newest"), 1).otherwise(0)).alias("tops"))
    tied = materialise(tops.filter("tops <> 1").select("url"), "tied")
    rest = drop_keys(pages, tied, "url")
    unnumbered = keys.filter("numbered < copies").select("url").distinct()
    outdated = keys.filter("page_id < newest").select("url", "page_id")
    rest = drop_keys(rest, outdated, ["url", "page_id"])
    # A copy without a number is older than any with one.
    blank = rest.filter("page_id is null")
    rest = rest.filter("page_id is not null").unionByName(drop_keys(blank, unnumbered, "url"))
    order = Window.partitionBy("url").orderBy(F.col("page_id").desc_nulls_last(), F.xxhash64("html"))
    some = keep_keys(pages, tied, "url")
    first = some.withColumn("__place", F.row_number().over(order)).filter("__place = 1").drop("__place")
    return rest.unionByName(first.select(*rest.columns))


# Walk defaults.
DEFAULTS = {"mode": "next", "url_template": None, "start_page": 1, "max_pages": 10, "stop_on_error": True}


def _seeds(crawls: DataFrame) -> DataFrame:
    """Seeds with defaults filled in and ``problem``, null for one that can be walked."""
    kinds = {"mode": "string", "url_template": "string", "start_page": "long", "max_pages": "long", "stop_on_error": "boolean"}

    def value(name: str) -> Column:
        given = [F.col(name)] if name in crawls.columns else []
        return F.coalesce(*given, F.lit(DEFAULTS[name])).cast(kinds[name]).alias(name)

    seeds = crawls.select("crawl_id", strip(F.col("start_url")).alias("start_url"), *map(value, DEFAULTS))
    template = F.coalesce(F.col("url_template"), F.lit(""))
    # Visits are told apart by the id of their crawl.
    repeated = materialise(seeds.groupBy("crawl_id").count().filter("crawl_id is not null and count > 1"), "repeated")
    repeated = repeated.select("crawl_id", F.lit(True).alias("repeated"))
    seeds = seeds.join(F.broadcast(repeated) if fits_broadcast(repeated) else repeated, "crawl_id", "left")
    problem = (
        F.when(F.col("crawl_id").isNull(), "crawl_id is missing")
        .when(F.col("repeated"), "crawl_id is repeated")
        .when(F.coalesce("start_url", F.lit("")) == "", "start_url is missing")
        .when(~F.col("start_url").rlike("^https?://"), "start_url is not an http(s) address")
        .when(~F.col("mode").isin(*MODES), F.concat(F.lit("unknown mode: "), F.col("mode")))
        .when(F.col("max_pages") < 1, "max_pages must be at least 1")
        .when((F.col("mode") == "template") & ~F.contains(template, F.lit("{page}")), "url_template lacks {page}")
    )
    return seeds.withColumn("problem", problem).drop("repeated")


def read_crawls(crawls: DataFrame) -> DataFrame:
    """Seeds that can be walked, with their defaults; ``seed_problems`` lists the others.

    Of seeds that share a ``crawl_id`` none can be walked, as nothing says which one is meant.
    """
    return _seeds(crawls).filter("problem is null").drop("problem")


def seed_problems(crawls: DataFrame) -> DataFrame:
    """``crawl_id, start_url, problem`` of every seed that cannot be walked."""
    return _seeds(crawls).filter("problem is not null").select("crawl_id", "start_url", "problem")
