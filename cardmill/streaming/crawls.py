"""Walks over pages that arrive as a stream: a crawl goes on when its next page is there.

Every batch of pages is parsed once and added to a table of narrow facts. Then all crawls
that wait take as many steps as the pages so far allow, and the visits are added to a table.
What a crawl waits for is a table too, written anew by each batch, so a batch that is
repeated after a failure starts from the same place and replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.blocks import asked_pages, follow
from ..operators.crawl import FACT_COLUMNS, site_facts, visited_pages, walk
from ..operators.extract import page_facts, parse_pages
from ..operators.joins import keep_keys
from ..operators.rules import PageRules, PagerRules
from ..session import materialise


class CrawlStream:
    """The tables of a streamed walk of ``crawls`` (``read_crawls``) in one folder.

    ``facts/batch=N`` has what was parsed, ``visits/batch=N`` the steps taken, ``waiting/batch=N``
    where each crawl stands after the batch. One row per URL is expected over all batches.
    """

    def __init__(self, spark: SparkSession, crawls: DataFrame, rules: PageRules, pager: PagerRules, folder: str):
        self.spark, self.rules, self.pager, self.folder = spark, rules, pager, folder
        self.crawls = materialise(crawls.filter("max_pages >= 1"), "crawls")
        kind = self.crawls.schema["crawl_id"].dataType
        self.state = T.StructType(
            [
                T.StructField("crawl_id", kind), T.StructField("url", T.StringType()), T.StructField("n", T.LongType()),
                T.StructField("guess", T.IntegerType()),
            ]
        )
        self.steps = T.StructType([T.StructField("crawl_id", kind), T.StructField("n", T.LongType()), T.StructField("url", T.StringType())])
        self.fact_schema: T.StructType | None = None

    def _read(self, name: str, schema: T.StructType, below: int) -> DataFrame:
        """The rows of all batches before ``below``."""
        folders = [f"{self.folder}/{name}/batch={k}" for k in range(below)]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def facts(self, batches: int) -> DataFrame:
        if self.fact_schema is None:
            nothing = self.spark.createDataFrame([], "url string, html string")
            self.fact_schema = self._facts(nothing).schema
        return self._read("facts", self.fact_schema, batches)

    def _facts(self, pages: DataFrame) -> DataFrame:
        read = page_facts(parse_pages(pages, self.rules, self.pager, keep=["url"]), self.rules, keep=["url"])
        return site_facts(read).select("url", *FACT_COLUMNS)

    def _waiting(self, batch: int) -> DataFrame:
        if batch == 0:
            start = self.crawls.select("crawl_id", F.col("start_url").alias("url"), F.lit(0).cast("long").alias("n"), F.lit(2).alias("guess"))
            return self.spark.createDataFrame([], self.state).unionByName(start)
        return self.spark.read.schema(self.state).parquet(f"{self.folder}/waiting/batch={batch - 1}")

    def advance(self, pages: DataFrame, batch: int) -> None:
        """Take in a batch of pages; ``foreachBatch`` calls this."""
        facts = self._facts(pages)
        self.fact_schema = facts.schema
        facts.write.mode("overwrite").parquet(f"{self.folder}/facts/batch={batch}")
        known = self.facts(batch + 1).select("url", "ok", "found", "kept", "next_url", "pager_urls")
        waiting, visits = materialise(self._waiting(batch), "waiting"), self._read("visits", self.steps, batch)
        taken = []
        while not waiting.isEmpty():
            asked = asked_pages(waiting, self.crawls)
            # A page that has not come yet is not there; its crawl stops before it.
            keys = materialise(asked.select("url").distinct(), "asked")
            block = asked.join(keep_keys(known, keys, "url"), "url")
            links = F.when(F.col("mode") == "next", F.array_compact(F.array("next_url"))).when(F.col("mode") == "links", F.col("pager_urls"))
            block = block.withColumn("links", F.coalesce(links, F.array().cast("array<string>")))
            block = materialise(block.select("crawl_id", "url", "ok", "found", "kept", "links"), "came")
            if block.isEmpty():
                break
            been = visits if not taken else visits.unionByName(_union(taken))
            made, going = follow(waiting, block, been, self.crawls)
            made = materialise(made, "made")
            if made.isEmpty():
                break
            taken.append(made)
            waiting = materialise(going, "waiting")
        own = _union(taken) if taken else self.spark.createDataFrame([], self.steps)
        own.write.mode("overwrite").parquet(f"{self.folder}/visits/batch={batch}")
        waiting.write.mode("overwrite").parquet(f"{self.folder}/waiting/batch={batch}")

    def start(self, pages: DataFrame, checkpoint: str, once: bool = True, on_batch: Callable[[int], None] | None = None) -> StreamingQuery:
        def take(batch_pages: DataFrame, batch: int) -> None:
            self.advance(batch_pages.select("url", "html"), batch)
            if on_batch is not None:
                on_batch(batch)

        writer = pages.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()

    def visited(self, batches: int) -> DataFrame:
        """The visits of the first ``batches`` batches, as ``visited_pages`` has them, for an observer meanwhile."""
        return visited_pages(self.crawls, materialise(self._read("visits", self.steps, batches), "visits"), self.facts(batches))

    def finished(self, batches: int) -> DataFrame:
        """All visits once no more pages come: pages that never came are failed visits, and walks go on past them as in a batch."""
        facts = materialise(self.facts(batches), "facts")
        waiting = self._waiting(batches).select("crawl_id").distinct()
        done = self._read("visits", self.steps, batches).join(waiting, "crawl_id", "left_anti")
        # What is still open is walked in one go over all facts.
        rest = walk(self.crawls.join(waiting, "crawl_id", "left_semi"), facts)
        return visited_pages(self.crawls, materialise(done.unionByName(rest), "visits"), facts)


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
