"""Queries over the catalogue rendered from ``part``: extraction and walks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.crawl import crawl, crawl_records, preview, site_facts, walk
from ..operators.extract import page_facts, parse_pages, records
from ..operators.gate import fetched_pages, resolve_attempts
from ..operators.joins import keep_keys
from ..operators.robots import allowed_pages, robots_policy
from ..operators.rules import FieldRule, PageRules
from ..operators.stats import crawl_errors, crawl_stats
from ..session import materialise
from ..sources.pages import spread
from .catalogue import (
    CARD_RULES,
    PAGER_RULES,
    brand_crawls,
    brand_no,
    catalogue_facts,
    catalogue_log,
    catalogue_pages,
    catalogue_parsed,
    catalogue_robots,
)
from .registry import query

# DuckDB: every card of the catalogue with its place and expected values.
CARDS = """
  SELECT p_brand AS brand, (rn - 1) // 20 + 1 AS page_no, ((rn - 1) % 20 + 1)::INT AS card_no, p_partkey AS k,
    regexp_extract(p_brand, '[0-9]+$')::BIGINT AS b, ceil(size / 20)::BIGINT AS pages, p_type, p_size,
    CASE WHEN p_partkey % 13 = 0 THEN '' ELSE p_name END AS title,
    CASE WHEN p_partkey % 17 = 0 THEN '' WHEN p_partkey % 4 = 3 THEN (cents // 100)::VARCHAR
      ELSE (cents // 100) || '.' || lpad((cents % 100)::VARCHAR, 2, '0') END AS price,
    CASE WHEN p_partkey % 13 = 0 THEN '' ELSE 'https://lots.example/lot/' || p_partkey END AS link,
    (p_size % 3 + 3) || '.5' AS rating
  FROM (SELECT *, round(p_retailprice * 1300)::BIGINT AS cents, count(*) OVER (PARTITION BY p_brand) AS size,
          row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part)
"""
PAGES = f"""
  SELECT brand, b, page_no, any_value(pages) AS pages, count(*) AS found, count_if(title <> '') AS kept,
    count_if(title <> '' AND price = '') AS empty_fields,
    'https://lots.example/b' || b || '?page=' || page_no AS url
  FROM ({CARDS}) GROUP BY brand, b, page_no
"""
# DuckDB: visits of the walk along the pages, without and with the faults on page 3.
WALK = PAGES
# Pages that a walk may visit: two more than the longest brand has.
LIMIT = f"SELECT max(pages) + 2 AS most FROM ({PAGES})"
STORED = f"""
  SELECT brand, b, page_no, pages, url, b % 4 AS fault,
    CASE WHEN page_no = 3 AND b % 4 = 0 THEN 0 WHEN page_no = 3 AND b % 4 = 1 THEN 1 ELSE found END AS found,
    CASE WHEN page_no = 3 AND b % 4 < 2 THEN 0 ELSE kept END AS kept
  FROM ({PAGES}) WHERE NOT (page_no = 3 AND b % 4 = 2)
"""


TEMPLATE_PLAN = f"""
  SELECT c.brand, n, 'https://lots.example/b' || c.b || '?page=' || n AS url, s.url IS NOT NULL AS ok,
    coalesce(s.found, 0) AS found, coalesce(s.kept, 0) AS kept,
    CASE WHEN s.url IS NULL THEN 'https://lots.example/b' || c.b || '?page=' || n || ': not in the snapshot'
         WHEN s.found = 0 THEN 'no element matches tr.lot' END AS error
  FROM (SELECT DISTINCT brand, b FROM ({PAGES})) c
  CROSS JOIN (SELECT unnest(range(1, most + 1)) AS n FROM ({LIMIT})) r
  LEFT JOIN ({{pages}}) s ON s.brand = c.brand AND s.page_no = n
"""


def template_visits(stop_on_error: bool, pages: str) -> str:
    """DuckDB: template visits up to the first stop."""
    plan = TEMPLATE_PLAN.replace("{pages}", pages)
    stop = "ok AND (found = 0 OR kept = 0)" + (" OR NOT ok" if stop_on_error else "")
    return f"""
      SELECT p.* FROM ({plan}) p LEFT JOIN
        (SELECT brand, min(n) AS last FROM ({plan}) WHERE {stop} GROUP BY brand) l ON p.brand = l.brand
      WHERE last IS NULL OR n <= last
    """


def facts(spark: SparkSession, sf_dir: str, **options: bool) -> DataFrame:
    return site_facts(catalogue_facts(spark, sf_dir, **options))


@query(f"SELECT brand, page_no, card_no, title, price, link, rating FROM ({CARDS}) WHERE title <> ''")
def catalog_cards(spark, sf_dir):
    keep = ["brand", "page_no"]
    return records(catalogue_parsed(spark, sf_dir), CARD_RULES, keep=keep)


@query(
    f"""SELECT brand, page_no, card_no, rating, 'https://lots.example/img/' || k || '.png' AS image,
    p_type || ' | ' || brand AS tags FROM ({CARDS})"""
)
def catalog_void(spark, sf_dir):
    """Values of empty elements and of a list with unclosed items."""
    rules = PageRules(
        "tr.lot",
        (
            FieldRule("rating", "meta.mark", transform="strip"),
            FieldRule("image", "img", transform="url"),
            FieldRule("tags", "ol.kinds > li", collect_all=True, join_with=" | "),
        ),
    )
    return records(catalogue_parsed(spark, sf_dir, rules), rules, keep=["brand", "page_no"])


@query(
    f"""SELECT brand, page_no, card_no, title, price, split_part(price, '.', 1) AS whole
    FROM ({CARDS}) WHERE title <> '' AND price <> ''"""
)
def catalog_required(spark, sf_dir):
    """A price that is no number counts as missing: required is checked after the transform."""
    amount = "td.sum"
    rules = PageRules(
        "tr.lot",
        (
            FieldRule("title", "th a", required=True),
            FieldRule("price", amount, transform="float", required=True),
            FieldRule("whole", amount, transform="int"),
        ),
    )
    return records(catalogue_parsed(spark, sf_dir, rules), rules, keep=["brand", "page_no"])


@query(f"SELECT brand, page_no, url, found, kept, found - kept AS skipped, empty_fields FROM ({PAGES})")
def page_counters(spark, sf_dir):
    parsed = catalogue_parsed(spark, sf_dir)
    counted = page_facts(parsed, CARD_RULES, keep=["brand", "page_no", "url"])
    return counted.select("brand", "page_no", "url", "found", "kept", "skipped", "empty_fields")


@query(
    f"""SELECT brand, page_no, CASE WHEN page_no < pages THEN 'https://lots.example/b' || b || '?page=' || (page_no + 1) END
      AS next_url, array_to_string(list_transform(list_sort(list_distinct(list_concat([1],
        range(greatest(page_no - 2, 1), least(page_no + 2, pages) + 1)))),
        lambda n: 'https://lots.example/b' || b || '?page=' || n), ' ') AS pager FROM ({PAGES})"""
)
def page_links(spark, sf_dir):
    parsed = catalogue_parsed(spark, sf_dir)
    return parsed.select("brand", "page_no", "next_url", F.array_join("pager_urls", " ").alias("pager"))


def visits(spark: SparkSession, sf_dir: str, mode: str, depth: int | None = None, **options: bool) -> DataFrame:
    return walk(brand_crawls(spark, sf_dir, mode, depth), facts(spark, sf_dir, **options))


@query(f"SELECT brand AS crawl_id, page_no AS n, url FROM ({WALK})")
def crawl_next(spark, sf_dir):
    return visits(spark, sf_dir, "next")


@query(f"SELECT brand AS crawl_id, page_no AS n, url FROM ({WALK})")
def crawl_links(spark, sf_dir):
    return visits(spark, sf_dir, "links")


@query(f"SELECT brand AS crawl_id, n, url FROM ({template_visits(True, PAGES)})")
def crawl_template(spark, sf_dir):
    return visits(spark, sf_dir, "template")


@query(f"SELECT brand AS crawl_id, page_no AS n, url FROM ({PAGES}) WHERE page_no = 1")
def crawl_none(spark, sf_dir):
    """Nothing is parsed for walks of one page: the facts are only a plan."""
    return walk(brand_crawls(spark, sf_dir, "none"), catalogue_facts(spark, sf_dir))


@query(f"SELECT brand AS crawl_id, page_no AS n, url FROM ({WALK})")
def crawl_cycle(spark, sf_dir):
    """The last page links back to the second one."""
    return visits(spark, sf_dir, "next", loops=True)


@query(f"SELECT brand AS crawl_id, page_no AS n, url FROM ({PAGES}) WHERE page_no <= 2")
def crawl_limit(spark, sf_dir):
    return visits(spark, sf_dir, "links", depth=2)


@query(f"SELECT brand AS crawl_id, page_no AS n, url, found, kept FROM ({WALK})")
def crawl_pages(spark, sf_dir):
    visited = crawl(brand_crawls(spark, sf_dir, "next"), facts(spark, sf_dir))
    return visited.select("crawl_id", "n", "url", "found", "kept")


@query(
    f"""SELECT brand AS crawl_id, page_no AS n, card_no, title, price, link, rating FROM ({CARDS})
    WHERE title <> ''"""
)
def crawled_records(spark, sf_dir):
    visited = crawl(brand_crawls(spark, sf_dir, "next"), facts(spark, sf_dir))
    return crawl_records(visited, CARD_RULES.names).drop("url")


@query(
    f"""SELECT brand AS crawl_id, pages, containers, "rows", containers - "rows" AS skipped,
      "rows" - distinct_rows AS duplicates, pages AS requests, 0::BIGINT AS errors, '' AS first_errors,
      CASE WHEN last_kept = 0 THEN 'empty_rows' ELSE 'no_next' END AS finish_reason
    FROM (SELECT brand, count(*) AS pages, sum(found)::BIGINT AS containers, sum(kept)::BIGINT AS "rows",
            max_by(kept, page_no) AS last_kept FROM ({WALK}) GROUP BY brand)
    JOIN (SELECT brand, count(DISTINCT {{'t': title, 'r': rating}}) AS distinct_rows FROM ({CARDS})
          WHERE title <> '' GROUP BY brand) USING (brand)""",
    name="crawl_stats",
)
def crawl_summary(spark, sf_dir):
    """Statistics of an output of title and rating, which repeat a lot."""
    visited = crawl(brand_crawls(spark, sf_dir, "next"), facts(spark, sf_dir))
    return readable(crawl_stats(visited, ["title", "rating"]))


def readable(stats: DataFrame) -> DataFrame:
    return stats.withColumn("first_errors", F.array_join("first_errors", " | "))


@query(
    f"""SELECT brand AS crawl_id, n, url, error FROM ({template_visits(False, STORED)}) WHERE error IS NOT NULL""",
    name="crawl_errors",
)
def failed_visits(spark, sf_dir):
    crawls = brand_crawls(spark, sf_dir, "template", stop_on_error=False)
    return crawl_errors(crawl(crawls, facts(spark, sf_dir, faults=True)))


@query(
    f"""SELECT brand AS crawl_id, count(*) AS pages, count(error) AS errors,
      coalesce(array_to_string(list_slice(list(error ORDER BY n) FILTER (error IS NOT NULL), 1, 10), ' | '), '') AS first_errors,
      CASE WHEN bool_or(ok AND found = 0) THEN 'no_items' WHEN bool_or(ok AND kept = 0) THEN 'empty_rows'
           ELSE 'max_pages' END AS finish_reason
    FROM ({template_visits(False, STORED)}) GROUP BY brand"""
)
def crawl_template_errors(spark, sf_dir):
    """More pages asked for than there are, errors passed over; the report shows ten of them."""
    crawls = brand_crawls(spark, sf_dir, "template", stop_on_error=False)
    stats = crawl_stats(crawl(crawls, facts(spark, sf_dir, faults=True)), CARD_RULES.names)
    return readable(stats).select("crawl_id", "pages", "errors", "first_errors", "finish_reason")


@query(
    f"""SELECT brand AS crawl_id, CASE WHEN last >= 3 THEN CASE fault WHEN 3 THEN last ELSE 3 END ELSE last END AS pages,
      CASE WHEN last >= 3 AND fault IN (0, 2) THEN 1 ELSE 0 END::BIGINT AS errors,
      CASE WHEN last >= 3 AND fault = 0 THEN 'no_items' WHEN last >= 3 AND fault = 1 THEN 'empty_rows'
           WHEN last >= 3 AND fault = 2 THEN 'error'
           WHEN last_kept = 0 THEN 'empty_rows' ELSE 'no_next' END AS finish_reason
    FROM (SELECT brand, any_value(b % 4) AS fault, any_value(pages) AS last, max_by(kept, page_no) AS last_kept
          FROM ({PAGES}) GROUP BY brand)"""
)
def crawl_stops(spark, sf_dir):
    """Walks that end at a page without cards, without rows, or not stored."""
    crawls = brand_crawls(spark, sf_dir, "next")
    stats = crawl_stats(crawl(crawls, facts(spark, sf_dir, faults=True)), CARD_RULES.names)
    return stats.select("crawl_id", "pages", "errors", "finish_reason")


@query(
    f"""SELECT brand AS crawl_id, found, card_no, title, price FROM (
      SELECT brand, card_no, title, price, count(*) OVER (PARTITION BY brand) AS found,
        row_number() OVER (PARTITION BY brand ORDER BY title = '', card_no) AS place FROM ({CARDS}) WHERE page_no = 1)
    WHERE place <= 5 AND title <> ''""",
    name="preview",
)
def first_rows(spark, sf_dir):
    """The preview: five rows of each start page; no other page is parsed."""
    crawls = materialise(brand_crawls(spark, sf_dir, "next"), "crawls")
    starts = materialise(crawls.select(F.col("start_url").alias("url")).distinct(), "starts")
    pages = keep_keys(catalogue_pages(spark, sf_dir), starts, "url")
    read = page_facts(parse_pages(spread(pages), CARD_RULES, PAGER_RULES, keep=["url"]), CARD_RULES, keep=["url"])
    return preview(crawls, site_facts(read), ["title", "price"])


@query(
    f"""SELECT brand AS crawl_id, CASE WHEN blocked THEN 1 ELSE pages END AS pages,
      CASE WHEN blocked THEN 0 ELSE pages + 2 END AS requests,
      CASE WHEN blocked THEN 1 ELSE 0 END::BIGINT AS errors,
      CASE WHEN blocked THEN 'https://lots.example/b' || b || '?page=1: denied by robots.txt' ELSE '' END AS first_errors,
      CASE WHEN blocked THEN 'error' WHEN last_kept = 0 THEN 'empty_rows'
           ELSE 'no_next' END AS finish_reason
    FROM (SELECT brand, b, any_value(pages) AS pages, max_by(kept, page_no) AS last_kept, b % 6 = 5 AS blocked
          FROM ({PAGES}) GROUP BY brand, b)"""
)
def gated_crawl(spark, sf_dir):
    """Fetch log, robots rules, extraction, walk and statistics in one go.

    First pages took three attempts; every sixth brand is closed to robots.
    """
    log = catalogue_log(catalogue_pages(spark, sf_dir))
    policy = robots_policy(catalogue_robots(spark, sf_dir))
    outcomes = materialise(resolve_attempts(log), "outcomes")
    pages = allowed_pages(fetched_pages(log, outcomes), policy)
    read = page_facts(parse_pages(pages, CARD_RULES, PAGER_RULES, keep=["url"]), CARD_RULES, keep=["url"])
    stored = site_facts(read, outcomes)
    visited = crawl(brand_crawls(spark, sf_dir, "next"), stored, policy)
    stats = readable(crawl_stats(visited, CARD_RULES.names))
    return stats.select("crawl_id", "pages", "requests", "errors", "first_errors", "finish_reason")


@query(
    f"""SELECT brand AS crawl_id, page_no AS n, url, b % 6 <> 5 AS ok, CASE WHEN b % 6 = 5 THEN 0 ELSE found END AS found,
      CASE WHEN b % 6 = 5 THEN url || ': denied by robots.txt' END AS error
    FROM ({PAGES}) WHERE b % 6 <> 5 OR page_no = 1"""
)
def denied_crawl(spark, sf_dir):
    """Robots rules on facts of all pages: a denied page is a failed visit and ends the walk."""
    policy = robots_policy(catalogue_robots(spark, sf_dir))
    visited = crawl(brand_crawls(spark, sf_dir, "next"), facts(spark, sf_dir), policy)
    return visited.select("crawl_id", "n", "url", "ok", "found", "error")


@query(
    f"""SELECT brand AS crawl_id, CASE WHEN b % 2 = 1 AND pages >= 2 THEN 2 ELSE pages END AS pages,
      CASE WHEN b % 2 = 1 AND pages >= 2 THEN 1 ELSE 0 END::BIGINT AS errors,
      CASE WHEN b % 2 = 1 AND pages >= 2 THEN url || '2: empty response' ELSE '' END AS first_errors,
      CASE WHEN b % 2 = 1 AND pages >= 2 THEN 'error' WHEN last_kept = 0 THEN 'empty_rows' ELSE 'no_next' END AS finish_reason
    FROM (SELECT brand, b, any_value(pages) AS pages, max_by(kept, page_no) AS last_kept,
            'https://lots.example/b' || b || '?page=' AS url FROM ({PAGES}) GROUP BY brand, b)"""
)
def blank_pages(spark, sf_dir):
    """The second page of every other brand is blank: a fetch error without a fetch log."""
    blank = (F.col("page_no") == 2) & (brand_no(F.col("brand")) % 2 == 1)
    pages = catalogue_pages(spark, sf_dir).withColumn("html", F.when(blank, F.lit(" \n")).otherwise(F.col("html")))
    read = page_facts(parse_pages(pages, CARD_RULES, PAGER_RULES, keep=["url"]), CARD_RULES, keep=["url"])
    stats = crawl_stats(crawl(brand_crawls(spark, sf_dir, "next"), site_facts(read)), CARD_RULES.names)
    return readable(stats).select("crawl_id", "pages", "errors", "first_errors", "finish_reason")
