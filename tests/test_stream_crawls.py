"""Walks over a page stream against the same walks over all pages at once."""

import random

from cardmill.operators.crawl import crawl, site_facts
from cardmill.operators.extract import page_facts, parse_pages
from cardmill.session import new_dir
from cardmill.sources.pages import read_crawls
from cardmill.streaming.crawls import CrawlStream
from cardmill.streaming.records import page_stream

from test_run import PAGER, RULES, SITE, html, random_site


def test_stream_equals_batch(spark):
    chance = random.Random(21)
    names, pages = random_site(chance, 10)
    seeds = spark.createDataFrame(
        [(k, chance.choice(names), mode, 6, False, f"{SITE}/a?page={{page}}") for k, mode in enumerate(["next", "links", "template", "none"] * 3)],
        "crawl_id long, start_url string, mode string, max_pages long, stop_on_error boolean, url_template string",
    )
    crawls = read_crawls(seeds)
    table = spark.createDataFrame([(k, url, html(*page)) for k, (url, page) in enumerate(pages.items())], "page_id long, url string, html string")
    folder = new_dir(spark, "files")
    for k in range(3):
        table.filter(f"pmod(xxhash64(url), 3) = {k}").coalesce(1).write.parquet(f"{folder}/{k}")
    stream = CrawlStream(spark, crawls, RULES, PAGER, new_dir(spark, "stream"))
    seen = []
    source = page_stream(spark, f"{folder}/*", files_per_batch=1)
    stream.start(source, new_dir(spark, "checkpoint"), on_batch=lambda batch: seen.append((batch, stream.visited(batch + 1).count()))).awaitTermination()
    columns = ["crawl_id", "n", "url", "ok", "found", "kept", "error"]
    found = sorted(map(tuple, stream.finished(len(seen)).select(*columns).collect()))
    facts = site_facts(page_facts(parse_pages(table, RULES, PAGER), RULES))
    assert found == sorted(map(tuple, crawl(crawls, facts).select(*columns).collect()))
    # Visits grow with the pages; a batch done once more leaves the same tables.
    assert [count for _, count in seen] == sorted(count for _, count in seen) and len(seen) == 3
    stream.advance(table.filter("pmod(xxhash64(url), 3) = 2").select("url", "html"), 2)
    assert len(stream.finished(3).collect()) == len(found)
