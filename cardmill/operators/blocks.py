"""Steps of many crawls at once: pages are asked for by their numbers, and the way through them is proved.

A crawl asks for its next page and those that page numbers lead to. If it comes to all
of them, it asks for twice as many the next time. That the walk goes from each of these
pages to the next one is a question about one page: is the next one its first link that
is neither among the pages before nor visited earlier? Joins answer it for all pages
side by side, so neither a walk nor a round of it is ever gathered in one row, and a walk
along page numbers takes as many rounds as its length has binary digits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import page_url
from ..session import materialise
from . import joins
from .joins import lookup

#: Pages that a crawl asks for in one round, at most.
AHEAD = 1 << 20
# Where an address has its page number.
PAGE_NUMBER = r"(?i)\A([^#]*[?&](?:page|p|offset)=)([0-9]{1,15})(?![0-9])(.*)\z"


def asked_pages(state: DataFrame, crawls: DataFrame) -> DataFrame:
    """``crawl_id, mode, url, k`` of every page that is asked for: the next one (0) and those its number leads to."""
    walks = crawls.select("crawl_id", "mode", "url_template", "start_page", "max_pages")
    state = lookup(state, walks, "crawl_id", how="inner", rows=0)
    ahead = F.least(F.col("guess").cast("long"), F.col("max_pages") - F.col("n"))
    rows = state.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), ahead - 1)))
    numbered = page_url(F.col("url_template"), F.col("start_page") + F.col("n") + F.col("k"))
    # A wrong guess costs a page that is parsed for nothing, so short numbers do.
    head, number, tail = (F.regexp_extract("url", PAGE_NUMBER, k) for k in (1, 2, 3))
    bumped = F.concat(head, (number.try_cast("long") + F.col("k")).cast("string"), tail)
    guess = F.when(F.col("mode") == "template", numbered).when(F.col("mode").isin("next", "links"), bumped)
    url = F.when(F.col("k") == 0, F.col("url")).otherwise(guess)
    rows = rows.select("crawl_id", "mode", url.alias("url"), "k").filter("url is not null")
    return rows.groupBy("crawl_id", "mode", "url").agg(F.min("k").alias("k"))


def follow(
    state: DataFrame, block: DataFrame, visits: DataFrame | None, crawls: DataFrame, ahead: int = AHEAD
) -> tuple[DataFrame, DataFrame]:
    """One round: the visits it makes (``crawl_id, n, url``) and the state of the crawls that go on.

    ``state`` has ``crawl_id, url, n, guess``: the next page, the visits made and the pages to ask for.
    ``block`` holds the pages of ``asked_pages`` that are there (``crawl_id, url, ok, found, kept, links``);
    a crawl stops before one that is not. ``visits`` are those of earlier rounds.
    """
    rows = state.agg(F.coalesce(F.sum("guess"), F.lit(0))).first()[0]
    settings = crawls.select("crawl_id", "mode", "start_url", "url_template", "start_page", "max_pages", "stop_on_error")
    walks = lookup(state.select("crawl_id", F.col("n").alias("before")), settings, "crawl_id", how="inner", rows=0)
    places = asked_pages(state, crawls).select("crawl_id", "url", "k")
    pages = block.select("crawl_id", "url", "ok", "found", "kept", "links").join(places, ["crawl_id", "url"])
    pages = lookup(pages, walks, "crawl_id", how="inner", rows=rows)
    pages = pages.withColumn("n", F.col("before") + F.col("k") + 1)
    template = F.col("mode") == "template"
    empty = F.col("ok") & ~((F.col("found") > 0) & (F.col("kept") > 0))
    ends = (F.col("n") >= F.col("max_pages")) | (~F.col("ok") & (F.col("stop_on_error") | ~template)) | empty
    numbered = page_url(F.col("url_template"), F.col("start_page") + F.col("n"))
    # The start page met again ends the walk before it.
    links = F.when(template, F.when(numbered != F.col("start_url"), F.array(numbered))).otherwise(F.col("links"))
    pages = materialise(pages.select("crawl_id", "url", "k", "n", F.when(~ends, links).alias("links")), "pages")

    links = pages.select("crawl_id", "k", F.posexplode("links").alias("at", "link")).filter("link is not null")
    place = pages.select("crawl_id", F.col("url").alias("link"), F.col("k").alias("to"))
    onward = links.join(place, ["crawl_id", "link"], "left").filter("to is null or to > k")
    if visits is not None:
        onward = _unvisited(onward, visits)
    first = onward.groupBy("crawl_id", "k").agg(F.min_by(F.struct("link", "to"), "at").alias("first"))
    whole = pages.select("crawl_id", "k", "n").join(first, ["crawl_id", "k"], "left")
    stays = ~F.coalesce(F.col("first.to") == F.col("k") + 1, F.lit(False))
    end = F.struct("k", "n", F.col("first.link").alias("following"))
    last = whole.groupBy("crawl_id").agg(F.min("k").alias("lowest"), F.min_by(end, F.when(stays, F.col("k"))).alias("end"))
    last = last.filter("lowest = 0").select("crawl_id", "end")
    walked = materialise(state.join(last, "crawl_id", "left"), "walked")

    ended = walked.filter("end is not null").select("crawl_id", F.col("end.k").alias("last"))
    made = lookup(pages.select("crawl_id", "n", "url", "k"), ended, "crawl_id", how="inner", rows=rows).filter("k <= last")
    # As long as every page asked for is visited, twice as many are asked for.
    guess = F.when(F.col("end.k") + 1 >= F.col("guess"), F.col("guess").cast("long") * 2).otherwise(F.lit(1).cast("long"))
    moved = F.col("end").isNotNull()
    going = walked.filter("end is null or end.following is not null").select(
        "crawl_id", F.when(moved, F.col("end.following")).otherwise(F.col("url")).alias("url"),
        F.when(moved, F.col("end.n")).otherwise(F.col("n")).alias("n"), F.least(guess, F.lit(ahead).cast("long")).cast("int").alias("guess"),
    )
    return made.select("crawl_id", "n", "url"), going


def _unvisited(links: DataFrame, visits: DataFrame) -> DataFrame:
    """Links without those that their crawl has visited; the links move, the visits do not."""
    links = materialise(links, "links")
    keys = links.select("crawl_id", F.col("link").alias("url")).distinct()
    been = visits.select("crawl_id", "url")
    size = links.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("link")), F.lit(0))).first()
    if size[0] <= joins.BROADCAST_ROWS and size[1] <= joins.BROADCAST_BYTES:
        # No more come back than were sent: a crawl visits an URL once.
        seen = F.broadcast(been.join(F.broadcast(keys), ["crawl_id", "url"], "left_semi"))
    else:
        seen = joins.keep_keys(been, materialise(keys, "keys"), ["crawl_id", "url"])
    return links.join(seen.withColumnRenamed("url", "link"), ["crawl_id", "link"], "left_anti")
