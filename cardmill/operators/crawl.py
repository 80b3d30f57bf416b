"""Walks over the stored link graph: which pages a crawl visits, in which order.

A walk only looks at ``page_facts`` (one narrow row per URL). Crawls run side by
side in the same jobs:

* ``template`` and ``none`` have a closed form;
* ``next`` follows one link per page, so paths of doubling length are composed:
  ``log2(max_pages)`` joins instead of ``max_pages``;
* ``links`` depends on the path so far: it advances level by level, long walks in blocks of page numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import origin, page_url
from ..session import materialise, new_dir
from . import joins
from .blocks import asked_pages, follow
from .extract import EMPTY, PLACE, origins
from .joins import lookup
from .robots import is_allowed, robots_filter
from .rules import MODES

CHUNK = 1000
#: Page numbers that a template walk tries first.
FIRST_BLOCK = 16
LEVELS_AT_ONCE = 8
#: Levels that a walk of mode ``links`` takes with its path in the row.
LEVELS = 64
# Edges worth a task of their own, and what one task may hold.
FEW_EDGES, MANY_EDGES = 10_000, 1_000_000
CRAWL_COLUMNS = ("crawl_id", "mode", "max_pages", "stop_on_error")
COUNTERS = ("found", "kept", "skipped", "empty_fields")
MISSING = "not in the snapshot"
#: What decides where a walk goes.
WALK_COLUMNS = ("url", "ok", "found", "kept", "next_url", "pager_urls")
FACT_COLUMNS = (
    "ok", "error", "found", "kept", "skipped", "empty_fields", "requests", "next_url", "pager_urls", "kept_cards",
)


def site_facts(facts: DataFrame, outcomes: DataFrame | None = None) -> DataFrame:
    """``page_facts`` of usable pages plus the URLs whose fetch failed.

    ``outcomes`` is ``resolve_attempts``; without a fetch log every page took
    one request. A blank page is a failed visit either way, and so is a fetched URL
    that the facts lack. The result is a written table, read once per walk.
    """
    blank = F.coalesce(F.col("error") == EMPTY, F.lit(False))
    pages = facts.withColumn("ok", ~blank)
    pages = pages.withColumn("error", F.when(blank, F.concat("url", F.lit(f": {EMPTY}"))).otherwise(F.col("error")))
    if outcomes is None:
        return materialise(pages.select("url", F.lit(1).cast("long").alias("requests"), *_without(("requests",))), "facts")
    joined = outcomes.select("url", "requests", F.col("ok").alias("fetched"), "problem").join(pages, "url", "left")
    counters = [F.coalesce(name, F.lit(0).cast("long")).alias(name) for name in COUNTERS]
    failed = F.concat("url", F.lit(": "), F.coalesce("problem", F.lit(MISSING)))
    table = joined.select(
        "url", "requests", F.coalesce("ok", F.lit(False)).alias("ok"),
        F.when(F.col("ok").isNotNull(), F.col("error")).otherwise(failed).alias("error"),
        *counters, "next_url", "pager_urls", "kept_cards",
    )
    return materialise(table, "facts")


def denied_facts(facts: DataFrame, policy: DataFrame) -> DataFrame:
    """What a walk looks at, with pages that robots rules deny as failed visits: no links to follow.

    Cards stay where they are: ``visited_pages`` asks the rules once more, for visits only.
    """
    judged = robots_filter(facts.select(*WALK_COLUMNS), policy)
    closed = judged.select(
        "url", *(F.when(F.col("allowed"), F.col(name)).alias(name) for name in WALK_COLUMNS if name not in ("url", "ok")),
        (F.col("ok") & F.col("allowed")).alias("ok"),
    )
    return materialise(closed.select(*WALK_COLUMNS), "walk-facts")


def _without(names: Sequence[str]) -> list[str]:
    return [name for name in FACT_COLUMNS if name not in names]


def _robots_error() -> Column:
    return F.concat("url", F.lit(": denied by robots.txt"))


def _has_rows() -> Column:
    return F.col("ok") & (F.col("found") > 0) & (F.col("kept") > 0)


def walk(crawls: DataFrame, facts: DataFrame) -> DataFrame:
    """``crawl_id, n, url``: the n-th visit of every crawl.

    A crawl of no pages has no visits; a mode that is none of the four is an error, so
    check seeds by ``read_crawls`` and ``seed_problems`` first.
    """
    others = crawls.filter(~F.coalesce(F.col("mode").isin(*MODES), F.lit(False))).select("crawl_id", "mode").first()
    if others is not None:
        raise ValueError(f"crawl {others['crawl_id']!r} has the unknown mode {others['mode']!r}")
    crawls = crawls.filter("max_pages >= 1")
    modes = crawls.groupBy("mode").agg(F.max("max_pages")).collect()  # four modes at most
    depth = {mode: int(pages) for mode, pages in modes}
    if not depth:
        return _start(crawls).select("crawl_id", "n", "url")
    parts = [
        walker(crawls.filter(F.col("mode") == mode), facts, depth[mode]).select("crawl_id", "n", "url")
        for mode, walker in (("next", _next), ("links", _links), ("template", _template), ("none", _none))
        if mode in depth
    ]
    visits = parts[0]
    for part in parts[1:]:
        visits = visits.unionByName(part)
    return visits


def _start(crawls: DataFrame) -> DataFrame:
    return crawls.select("crawl_id", "max_pages", F.lit(1).cast("long").alias("n"), F.col("start_url").alias("url"))


def _none(crawls: DataFrame, facts: DataFrame, depth: int) -> DataFrame:
    return _start(crawls)


def _next(crawls: DataFrame, facts: DataFrame, depth: int) -> DataFrame:
    jump = facts.filter(_has_rows() & F.col("next_url").isNotNull()).select("url", F.col("next_url").alias("far"))
    jump = reachable(jump, crawls)
    visits, rows = _start(crawls), crawls.count()
    step, legs = 1, jump.count()
    while step < depth and legs > 0:
        hop = F.expr(
            f"filter(array(struct(n, url), struct(n + {step} as n, far as url)), v -> v.url is not null and v.n <= max_pages)"
        )
        longer = lookup(visits, jump, "url", rows=rows).select("crawl_id", "max_pages", F.explode(hop).alias("visit"))
        # A page seen before ends the walk: only the first visit stays.
        longer = longer.groupBy("crawl_id", "max_pages", F.col("visit.url").alias("url"))
        visits, rows, step = longer.agg(F.min("visit.n").alias("n")), rows * 2, step * 2
        if rows > joins.SMALL_ROWS:
            visits = materialise(visits, "visits")
            rows = visits.count()
        if step < depth:
            first = jump.select(F.col("url").alias("source"), F.col("far").alias("url"))
            # One successor per page: a composed table is never longer.
            jump = lookup(first, jump, "url", how="inner", rows=legs)
            jump = materialise(jump.select(F.col("source").alias("url"), "far"), "jump")
            legs = jump.count()
    return visits


def reachable(edges: DataFrame, crawls: DataFrame, rounds: int = 8) -> DataFrame:
    """Edges of the origins that walks can come to: those of the seeds, and of links that leave them.

    Origins are found in rounds over links between origins, which are few; a snapshot of many
    sites is read once and what is not crawled is not moved. ``edges`` has ``url, far``. After
    ``rounds`` without an end, or with too many origins, all edges stay: the walk is the same.
    """
    known = materialise(crawls.select(origin(F.col("start_url")).alias("site")).distinct(), "origins")
    sites = edges.select(origin(F.col("url")).alias("site"), origin(F.col("far")).alias("to"))
    ways = materialise(sites.filter("site <> to").distinct(), "ways")
    for _ in range(rounds):
        if not joins.fits_broadcast(known):
            return edges
        far = ways.join(F.broadcast(known), "site", "left_semi").select(F.col("to").alias("site"))
        more = materialise(far.distinct().join(F.broadcast(known), "site", "left_anti"), "origins")
        if more.isEmpty():
            own = edges.withColumn("site", origin(F.col("url"))).join(F.broadcast(known), "site", "left_semi")
            return materialise(own.drop("site"), "edges")
        known = materialise(known.unionByName(more), "origins")
    return edges


def _links(crawls: DataFrame, facts: DataFrame, depth: int) -> DataFrame:
    """Level by level with the path in the row at first; walks that go on take blocks of page numbers.

    A walk that is not where its page numbers lead goes back to levels, and tries again after ``LEVELS`` of them.
    """
    edges = place_by_url(facts.filter(_has_rows() & (F.size("pager_urls") > 0)).select("url", "pager_urls"))
    state = _start(crawls).select(
        "crawl_id", "max_pages", "url", F.array("url").alias("seen"), F.lit(False).alias("done")
    )
    settings = crawls.select(
        "crawl_id", F.lit("links").alias("mode"), "start_url", F.lit(None).cast("string").alias("url_template"),
        F.lit(1).cast("long").alias("start_page"), "max_pages", F.lit(True).alias("stop_on_error"),
    )
    parts, level = [], 0
    while True:
        ended, going = _levels(state, edges, min(depth, level + LEVELS) - level)
        parts.append(ended)
        level += LEVELS
        if level >= depth or going.isEmpty():
            break
        # The last page of the path counts as the next one to visit.
        path = going.select("crawl_id", F.posexplode("seen").alias("at", "url"), F.size("seen").alias("pages"))
        path = path.filter("at < pages - 1").select("crawl_id", (F.col("at") + 1).cast("long").alias("n"), "url")
        visits = [materialise(path, "path")]
        walks = materialise(settings.join(going.select("crawl_id"), "crawl_id", "left_semi"), "walks")
        ahead = going.select("crawl_id", "url", (F.size("seen") - 1).cast("long").alias("n"), F.lit(2).alias("guess"))
        lost = []
        while not ahead.isEmpty():
            block = _block_of_links(asked_pages(ahead, walks), edges)
            been = visits[0]
            for more in visits[1:]:
                been = been.unionByName(more)
            made, after = follow(ahead, block, been, walks)
            visits.append(materialise(made, "made"))
            lost.append(after.filter("guess < 2"))
            ahead = after.filter("guess >= 2")
        been = visits[0]
        for more in visits[1:]:
            been = been.unionByName(more)
        rest = lost[0]
        for more in lost[1:]:
            rest = rest.unionByName(more)
        rest = materialise(rest.select("crawl_id", "url"), "lost")
        parts.append(been.join(rest, "crawl_id", "left_anti"))
        if rest.isEmpty():
            break
        step = F.struct("n", "url")
        back = been.join(rest.select("crawl_id"), "crawl_id", "left_semi").groupBy("crawl_id").agg(F.array_sort(F.collect_list(step)).alias("steps"))
        back = back.join(rest, "crawl_id").join(crawls.select("crawl_id", "max_pages"), "crawl_id")
        seen = F.concat(F.transform("steps", lambda v: v["url"]), F.array("url"))
        state = back.select("crawl_id", "max_pages", "url", seen.alias("seen"), F.lit(False).alias("done"))
    edges.unpersist()
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _block_of_links(asked: DataFrame, edges: DataFrame) -> DataFrame:
    """Pages of a block as ``follow`` takes them; one without edges has no links, which ends the walk there."""
    links = F.coalesce("pager_urls", F.array().cast("array<string>")).alias("links")
    one = F.lit(1).cast("long")
    joined = asked.join(edges, "url", "left")
    block = joined.select("crawl_id", "url", F.lit(True).alias("ok"), one.alias("found"), one.alias("kept"), links)
    return materialise(block, "block")


def _levels(state: DataFrame, edges: DataFrame, levels: int) -> tuple[DataFrame, DataFrame]:
    """Visits of the walks that end within so many levels, and the state of those that go on."""
    spark = state.sparkSession
    folder = new_dir(spark, "links")
    state = materialise(state, "frontier")
    schema, level, batch = state.schema, 0, 0
    while level < levels and (rows := state.count()) > 0:
        small = rows <= joins.SMALL_ROWS
        for _ in range(min(LEVELS_AT_ONCE, levels - level) if small else 1):
            state = _advance(lookup(state, edges, "url", rows=rows))
            level += 1
        state.write.partitionBy("done").parquet(f"{folder}/batch={batch}")
        state = _states(spark, schema, f"{folder}/batch={batch}", "false")
        batch += 1
    ended = _states(spark, schema, f"{folder}/batch=*", "true")
    ended = ended.select("crawl_id", F.posexplode("seen").alias("n", "url"))
    return ended.withColumn("n", (F.col("n") + 1).cast("long")), state


def place_by_url(edges: DataFrame) -> DataFrame:
    """Dealt out and sorted by URL once: each level then moves the frontier only.

    The copy on executors is a cache of a written table, so losing one of them
    costs reading its part again.
    """
    rows, tasks = edges.count(), int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(min(tasks, rows // FEW_EDGES), rows // MANY_EDGES, 1)
    placed = edges.repartition(tasks, "url").sortWithinPartitions("url").persist()
    placed.count()  # only a filled cache tells the planner how it is laid out
    return placed


def _advance(joined: DataFrame) -> DataFrame:
    """To the first link of the page that this walk has not seen."""
    following = joined.selectExpr(
        "crawl_id", "max_pages", "url", "seen",
        """case when not done and size(seen) < max_pages
           then get(filter(pager_urls, link -> not array_contains(seen, link)), 0) end as following""",
    )
    return following.selectExpr(
        "crawl_id",
        "max_pages",
        "coalesce(following, url) as url",
        "if(following is null, seen, concat(seen, array(following))) as seen",
        "following is null as done",
    )


def _states(spark: SparkSession, schema, path: str, done: str) -> DataFrame:
    """Walks that ended, or go on; there may be none of either kind."""
    columns = [f for f in schema.fields if f.name != "done"]
    reader = spark.read.schema(type(schema)([*columns, schema["done"]]))
    return reader.option("basePath", path.split("/batch=")[0]).parquet(path).filter(f"done = {done}").drop("batch")


def _template(crawls: DataFrame, facts: DataFrame, depth: int) -> DataFrame:
    """Page numbers in blocks, each twice as long as the one before, until every crawl has met its end.

    So at most twice as many addresses are written as pages are visited, whatever ``max_pages`` is.
    """
    spark, low, size = crawls.sparkSession, 1, FIRST_BLOCK
    folder = new_dir(spark, "template")
    facts = facts.select("url", "ok", "found", "kept")
    going, blocks, schema = materialise(crawls, "going"), 0, None
    while low <= depth:
        block = _block(going, facts, low, size)
        schema = block.schema
        block.write.parquet(f"{folder}/block={blocks}")
        block = spark.read.schema(schema).parquet(f"{folder}/block={blocks}")
        low, size, blocks = low + size, size * 2, blocks + 1
        if low > depth:
            break
        ended = block.filter("last").select("crawl_id").distinct()
        going = going.filter(F.col("max_pages") >= low).join(ended, "crawl_id", "left_anti")
        going = materialise(going, "going")
        if going.isEmpty():
            break
    return spark.read.schema(schema).parquet(f"{folder}/block=*")


def _block(crawls: DataFrame, facts: DataFrame, low: int, size: int) -> DataFrame:
    """Visits of the numbers ``low`` to ``low + size - 1``, and whether one is known to be the crawl's last."""
    high = F.least(F.lit(low + size - 1).cast("long"), F.col("max_pages"))
    # Two steps, dealt out in between, so that a long block of one crawl is many rows' work.
    starts = crawls.filter(F.col("max_pages") >= low)
    starts = starts.withColumn("from", F.explode(F.sequence(F.lit(low).cast("long"), high, F.lit(CHUNK).cast("long"))))
    if size > CHUNK:
        starts = starts.repartition("crawl_id", "from")
    numbered = starts.withColumn("n", F.explode(F.sequence("from", F.least(F.col("from") + (CHUNK - 1), high))))
    number = F.col("start_page") + F.col("n") - 1
    url = F.when(F.col("n") == 1, F.col("start_url")).otherwise(page_url(F.col("url_template"), number))
    # The start page met again ends the walk before it.
    again = (F.col("n") > 1) & (url == F.col("start_url"))
    plan = numbered.select(
        "crawl_id", F.col("n").cast("long").alias("n"), url.alias("url"), "stop_on_error", again.alias("again")
    )
    plan = materialise(plan, "block")
    seen = lookup(plan, facts, "url", written=True)
    ok = F.coalesce("ok", F.lit(False))
    ends = F.when(ok, (F.col("found") == 0) | (F.col("kept") == 0)).otherwise(F.col("stop_on_error"))
    limits = seen.groupBy("crawl_id").agg(
        F.least(F.min(F.when(F.col("again"), F.col("n") - 1)), F.min(F.when(ends, F.col("n")))).alias("limit")
    )
    joined = lookup(plan, limits, "crawl_id")
    visits = joined.filter(F.col("limit").isNull() | (F.col("n") <= F.col("limit")))
    return visits.select("crawl_id", "n", "url", F.col("limit").isNotNull().alias("last"))


def visited_pages(
    crawls: DataFrame, visits: DataFrame, facts: DataFrame, policy: DataFrame | None = None
) -> DataFrame:
    """Visits with what their page held; a URL nobody stored is a failed visit.

    ``visits`` should be a written table: it is counted before the joins.
    """
    rows = visits.count()
    joined = lookup(visits, facts.withColumn("stored", F.lit(True)), "url", rows=rows, written=True)
    missing = F.concat("url", F.lit(f": {MISSING}"))
    error = F.when(F.col("stored"), F.col("error")).otherwise(missing)
    requests = F.coalesce("requests", F.lit(1).cast("long"))
    if policy is not None:
        site = origin(F.col("url")).alias("__origin")
        rules = policy.select(F.col("origin").alias("__origin"), "closed", "rules")
        joined = lookup(joined.select("*", site), rules, "__origin", rows=rows, counted=visits.select(site))
        denied = ~is_allowed(F.col("url"))
        error = F.when(denied, _robots_error()).otherwise(error)
        requests = F.when(denied, F.lit(0).cast("long")).otherwise(requests)
    open_page = F.lit(True) if policy is None else ~denied
    counters = [F.when(open_page, F.coalesce(c, F.lit(0).cast("long"))).otherwise(0).alias(c) for c in COUNTERS]
    joined = joined.select(
        "crawl_id", "n", "url", (F.coalesce("ok", F.lit(False)) & open_page).alias("ok"), error.alias("error"),
        requests.alias("requests"), *counters, F.when(open_page, F.col("kept_cards")).alias("kept_cards"),
    )
    return lookup(joined, crawls.select(*CRAWL_COLUMNS), "crawl_id", how="inner", rows=rows, counted=visits)


def crawl(crawls: DataFrame, facts: DataFrame, policy: DataFrame | None = None) -> DataFrame:
    """Walk and look up: one row per visit (see ``visited_pages``).

    With a ``policy`` the walk stops at pages it denies, or goes past them, as at any
    failed visit.
    """
    visits = materialise(walk(crawls, facts if policy is None else denied_facts(facts, policy)), "walk")
    return visited_pages(crawls, visits, facts, policy)


def crawl_records(visited: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The kept cards of every visit, in visit and document order columns."""
    cards = visited.select("crawl_id", "n", "url", F.explode("kept_cards").alias("__card"))
    where = {name: F.col(name) for name in ("crawl_id", "n", "url")}
    return cards.select(*origins({**where, "card_no": F.col("__card")[PLACE]}, fields), *_fields(fields))


def _fields(names: Sequence[str]) -> list[Column]:
    return [F.col("__card")[name].alias(name) for name in names]


def preview(crawls: DataFrame, facts: DataFrame, fields: Sequence[str], limit: int = 5) -> DataFrame:
    """First kept cards of each start page and how many cards it has."""
    starts = crawls.select("crawl_id", F.col("start_url").alias("url"))
    pages = lookup(starts, facts.select("url", "found", "kept_cards"), "url", how="inner", written=True)
    cards = pages.select("crawl_id", "found", F.explode(F.slice("kept_cards", 1, limit)).alias("__card"))
    where = {"crawl_id": F.col("crawl_id"), "found": F.col("found"), "card_no": F.col("__card")[PLACE]}
    return cards.select(*origins(where, fields), *_fields(fields))
