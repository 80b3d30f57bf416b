"""Runs over the stored catalogue that parse what they visit; specs come from the ``part`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.run import Run, fixed_runs, run_crawls, run_output, run_records, spec_runs
from ..operators.stats import crawl_stats
from ..session import materialise, new_dir
from ..sources.pages import read_crawls, seed_problems
from ..streaming.crawls import CrawlStream
from ..streaming.records import page_stream
from .catalogue import CARD_RULES, PAGER_RULES, SITE, brand_crawls, brand_no, catalogue_pages, catalogue_robots, catalogue_store, read
from .catalogue_queries import CARDS, PAGES, STORED, WALK, readable, template_visits
from .registry import query

# Fields of a brand's spec, by its number modulo 3.
FIELDS = (
    '[{"name":"title","selector":"a.what","required":true},{"name":"price","selector":"td.sum","transform":"price"}]',
    '[{"name":"title","selector":"th a.what","required":true},{"name":"link","selector":"a.what","attribute":"href",'
    '"transform":"url"},{"name":"rating","selector":"meta.mark","attribute":"content","transform":"float"}]',
    '[{"name":"price","selector":"td.sum","transform":"float","required":true},'
    '{"name":"kinds","selector":"ol.kinds > li","all":true,"join_with":" | "}]',
)


def brand_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A spec per brand: everything in it follows from the brand's number, and two brands have a broken one."""
    brands = read(spark, sf_dir, "part").select(F.col("p_brand").alias("spec_id")).distinct()
    b = brand_no(F.col("spec_id"))
    text = b.cast("string")

    def flag(column):
        return F.when(column, F.lit("true")).otherwise("false")

    mode = F.element_at(F.array(*map(F.lit, ("next", "links", "template", "none"))), ((F.floor(b / 10) + b) % 4 + 1).cast("int"))
    fields = F.element_at(F.array(*map(F.lit, FIELDS)), (b % 3 + 1).cast("int"))
    url = F.concat(F.lit(f"{SITE}/b"), text, F.lit("?page="))
    spec = F.concat(
        F.lit('{"start_url":"'), url, F.lit('1","item":{"container":"tr.lot","fields":'), fields,
        F.lit('},"pagination":{"mode":"'), mode, F.lit('","next_selector":"a.onward","link_selector":"a.leaf","url_template":"'),
        url, F.lit('{page}","max_pages":'), F.when(b % 11 == 0, F.lit("0")).otherwise((b % 7 + 1).cast("string")),
        F.lit('},"retries":'), (b % 3 + 1).cast("string"), F.lit(',"respect_robots_txt":'), flag(b % 2 == 1),
        F.lit(',"stop_on_error":'), flag(b % 5 != 0), F.lit(',"output":{"path":"lots/'), (b % 4).cast("string"),
        F.lit('.csv","deduplicate":'), flag(b % 3 != 0), F.lit(',"append":'), flag(b % 2 == 0), F.lit("}}"),
    )
    return brands.select("spec_id", spec.alias("spec_json"))


# DuckDB: the settings of every brand whose spec has no problem.
SPECS = f"""
  SELECT brand, b, b % 3 AS kind, ['next', 'links', 'template', 'none'][(b // 10 + b) % 4 + 1] AS mode, b % 7 + 1 AS most,
    b % 3 + 1 AS retries, b % 2 = 1 AND b % 6 = 5 AS denied, b % 5 <> 0 AS stops, pages
  FROM (SELECT brand, b, max(page_no) AS pages FROM ({PAGES}) GROUP BY brand, b) WHERE b % 11 <> 0
"""
# Cards as they are stored, page 3 with its faults, and what a spec takes of them.
TAKEN = f"""
  SELECT s.brand, page_no, card_no, CASE kind WHEN 2 THEN price <> '' ELSE title <> '' END AS kept,
    CASE kind WHEN 0 THEN to_json({{'title': title, 'price': price}}) WHEN 1 THEN to_json({{'title': title, 'link': link, 'rating': rating}})
      ELSE to_json({{'price': price, 'kinds': kinds}}) END::VARCHAR AS record,
    CASE kind WHEN 0 THEN price = '' ELSE false END AS blank
  FROM ({SPECS}) s JOIN (
    SELECT brand, page_no, card_no, title, price, link, rating, p_type || ' | ' || brand AS kinds FROM ({CARDS})
      WHERE NOT (page_no = 3 AND b % 4 < 3)
    UNION ALL SELECT DISTINCT brand, 3, 1, '', '17', '', '', '' FROM ({CARDS}) WHERE page_no = 3 AND b % 4 = 1) c USING (brand)
"""
PLANNED = f"""
  SELECT s.*, n, 'https://lots.example/b' || b || '?page=' || n AS url,
    CASE WHEN denied THEN 'denied by robots.txt' WHEN n = 1 AND retries < 2 THEN 'HTTP 503'
      WHEN n > pages OR (n = 3 AND b % 4 = 2) THEN 'not in the snapshot' END AS problem,
    CASE WHEN denied THEN 0 WHEN n = 1 THEN least(retries + 1, 3) ELSE 1 END AS requests,
    coalesce(t.found, 0) AS cards, coalesce(t.kept, 0) AS whole, coalesce(t.empty, 0) AS empty
  FROM ({SPECS}) s CROSS JOIN LATERAL (SELECT unnest(range(1, most + 1)) AS n)
  LEFT JOIN (SELECT brand, page_no, count(*) AS found, count_if(kept) AS kept, count_if(kept AND blank) AS empty FROM ({TAKEN})
             GROUP BY brand, page_no) t ON t.brand = s.brand AND t.page_no = n
"""
VISITED = f"""
  SELECT *, if(ok, cards, 0) AS found, if(ok, whole, 0) AS kept,
    CASE WHEN NOT ok THEN url || ': ' || problem WHEN cards = 0 THEN 'no element matches tr.lot' END AS error
  FROM (SELECT *, problem IS NULL AS ok FROM ({PLANNED})) p
  WHERE n <= (SELECT min(CASE WHEN mode = 'none' OR n = most OR (q.problem IS NULL AND (cards = 0 OR whole = 0))
      OR (q.problem IS NOT NULL AND (stops OR mode <> 'template')) OR (mode IN ('next', 'links') AND n = pages) THEN n END)
    FROM ({PLANNED}) q WHERE q.brand = p.brand)
"""
KEPT = f"SELECT v.brand, v.n, t.card_no, t.record FROM ({VISITED}) v JOIN ({TAKEN}) t ON t.brand = v.brand AND t.page_no = v.n WHERE v.ok AND t.kept"


def brand_run(spark: SparkSession, sf_dir: str) -> Run:
    crawls = spec_runs(brand_specs(spark, sf_dir))
    return run_crawls(crawls, catalogue_store(spark, sf_dir, faults=True), catalogue_robots(spark, sf_dir))


@query(
    f"""SELECT brand AS crawl_id, count(*) AS pages, sum(found)::BIGINT AS containers, sum(kept)::BIGINT AS "rows",
      sum(found - kept)::BIGINT AS skipped, any_value(coalesce(repeats, 0))::BIGINT AS duplicates, sum(requests)::BIGINT AS requests,
      count(error) AS errors, coalesce(array_to_string(list_slice(list(error ORDER BY n) FILTER (error IS NOT NULL), 1, 10), ' | '), '') AS first_errors,
      CASE WHEN max_by(NOT ok AND stops, n) THEN 'error' WHEN max_by(ok AND found = 0, n) THEN 'no_items'
        WHEN max_by(ok AND kept = 0, n) THEN 'empty_rows' WHEN max(n) >= any_value(most) THEN 'max_pages' ELSE 'no_next' END AS finish_reason
    FROM ({VISITED}) LEFT JOIN (SELECT brand, count(*) - count(DISTINCT record) AS repeats FROM ({KEPT}) GROUP BY brand) USING (brand)
    GROUP BY brand"""
)
def spec_run(spark, sf_dir):
    """Whole runs of a table of specs: lint, robots, attempts, extraction by each spec's rules, walk, statistics."""
    return readable(crawl_stats(brand_run(spark, sf_dir).visited(), ["record"]))


@query(f"SELECT brand AS crawl_id, n, card_no, record FROM ({KEPT})")
def spec_run_records(spark, sf_dir):
    """Records of unlike fields side by side."""
    return run_records(brand_run(spark, sf_dir)).select("crawl_id", "n", "card_no", "record")


@query(
    f"""SELECT 'lots/' || b % 4 || '.csv' AS output_path, brand AS crawl_id, record FROM ({KEPT}) JOIN ({SPECS}) USING (brand)
    WHERE b % 3 = 0
    UNION ALL SELECT DISTINCT 'lots/' || b % 4 || '.csv', brand, record FROM ({KEPT}) JOIN ({SPECS}) USING (brand)
    WHERE b % 3 <> 0 AND NOT (b % 2 = 0 AND length(record) % 5 = 0)"""
)
def spec_run_output(spark, sf_dir):
    """What each output gets; a fifth of the records is there already and counts only for specs that append without repeats."""
    run = brand_run(spark, sf_dir)
    rows = run_records(run).join(run.crawls.select("crawl_id", "output_path"), "crawl_id")
    known = materialise(rows.filter(F.length("record") % 5 == 0).select("output_path", "record"), "known")
    return run_output(run, known)


def plain_run(spark: SparkSession, sf_dir: str, mode: str, ahead: int | None = None, **options: bool) -> Run:
    crawls = fixed_runs(read_crawls(brand_crawls(spark, sf_dir, mode, stop_on_error=False)), CARD_RULES, PAGER_RULES)
    store = catalogue_store(spark, sf_dir, logged=False, **options)
    return run_crawls(crawls, store, **({} if ahead is None else {"ahead": ahead}))


@query(f"SELECT brand AS crawl_id, page_no AS n, url, found, kept FROM ({WALK})")
def run_next(spark, sf_dir):
    """Walks that parse the pages of their way only."""
    return plain_run(spark, sf_dir, "next", loops=True).visited().select("crawl_id", "n", "url", "found", "kept")


@query(f"SELECT brand AS crawl_id, page_no AS n, url, found, kept FROM ({WALK})")
def run_links(spark, sf_dir):
    return plain_run(spark, sf_dir, "links").visited().select("crawl_id", "n", "url", "found", "kept")


@query(f"SELECT brand AS crawl_id, n, url, ok, error FROM ({template_visits(False, PAGES)})")
def run_template(spark, sf_dir):
    return plain_run(spark, sf_dir, "template").visited().select("crawl_id", "n", "url", "ok", "error")


@query(f"SELECT brand AS crawl_id, count(*) AS visits, count(*) AS parsed FROM ({PAGES}) WHERE page_no <= 3 GROUP BY brand")
def run_pages_parsed(spark, sf_dir):
    """Without guesses exactly the visited pages are parsed."""
    crawls = fixed_runs(read_crawls(brand_crawls(spark, sf_dir, "next", 3)), CARD_RULES, PAGER_RULES)
    run = run_crawls(crawls, catalogue_store(spark, sf_dir, logged=False), ahead=1)
    visits = run.visits.groupBy("crawl_id").agg(F.count("*").alias("visits"))
    parsed = run.read.groupBy("crawl_id").agg(F.count_if("parsed").alias("parsed"))
    return visits.join(parsed, "crawl_id")


@query(
    f"""SELECT brand AS crawl_id, count(*) AS pages, sum(kept)::BIGINT AS "rows", count(error) AS errors
    FROM ({template_visits(False, STORED)}) GROUP BY brand"""
)
def stream_crawls(spark, sf_dir):
    """Template walks over pages that come in three files; each goes on as far as its pages are there."""
    pages = catalogue_pages(spark, sf_dir, faults=True)
    folder = new_dir(spark, "page-files")
    for k in range(3):
        part = pages.filter(F.pmod(F.xxhash64("url"), F.lit(3)) == k).select("page_id", "url", "html")
        part.coalesce(1).write.parquet(f"{folder}/{k}")
    crawls = read_crawls(brand_crawls(spark, sf_dir, "template", stop_on_error=False))
    stream = CrawlStream(spark, crawls, CARD_RULES, PAGER_RULES, new_dir(spark, "stream"))
    batches = []
    source = page_stream(spark, f"{folder}/*", files_per_batch=1)
    stream.start(source, new_dir(spark, "checkpoint"), on_batch=batches.append).awaitTermination()
    visited = stream.finished(len(set(batches)))
    return visited.groupBy("crawl_id").agg(
        F.count("*").alias("pages"), F.sum("kept").alias("rows"), F.count("error").alias("errors")
    )


@query(
    """SELECT c_custkey AS crawl_id, CASE WHEN c_custkey % 10 < 3 THEN 'crawl_id is repeated' ELSE 'walked' END AS problem, count(*) AS seeds
    FROM (SELECT c_custkey FROM customer UNION ALL SELECT c_custkey FROM customer WHERE c_custkey % 10 < 3) GROUP BY ALL
    UNION ALL SELECT NULL, 'crawl_id is missing', count(*) FROM customer WHERE c_custkey % 10 = 9"""
)
def repeated_seeds(spark, sf_dir):
    """Seeds of customers, three tenths of them twice, and as many without an id as there are customers of a tenth."""
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("crawl_id"))
    twice, none = customers.filter("crawl_id % 10 < 3"), customers.filter("crawl_id % 10 = 9").select(F.lit(None).cast("long").alias("crawl_id"))
    address = F.concat(F.lit("https://site"), F.coalesce(F.col("crawl_id").cast("string"), F.lit("")), F.lit(".test/"))
    seeds = customers.unionByName(twice).unionByName(none).withColumn("start_url", address)
    good = read_crawls(seeds).select("crawl_id", F.lit("walked").alias("problem"))
    both = seed_problems(seeds).select("crawl_id", "problem").unionByName(good)
    return both.groupBy("crawl_id", "problem").agg(F.count("*").alias("seeds"))
