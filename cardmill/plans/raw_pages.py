"""Queries over the stored raw pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import bump_page
from ..functions.values import number, price, strip, text, whole
from ..operators.clean import clean_records, distinct_records, duplicate_counts, new_records
from ..operators.extract import page_facts, parse_pages, records
from ..operators.rules import FieldRule, PageRules
from ..session import new_dir
from ..sources.csv_output import read_output, write_records
from ..sources.pages import latest_pages, read_pages, spread
from ..streaming import records as streams
from .catalogue import price_text, read
from .registry import query

LINK_RULES = PageRules(
    "nav li", (FieldRule("text", "a", required=True), FieldRule("link", "a", "href", "url"))
)

# DuckDB: every navigation link of every page.
LINKS = r"""
  SELECT page_id, url, unnest(range(1, len(hrefs) + 1))::INT AS card_no,
         trim(regexp_replace(replace(unnest(texts), '&amp;', '&'), '\s+', ' ', 'g')) AS text,
         regexp_extract(url, '^https?://[^/]+') || replace(unnest(hrefs), '&amp;', '&') AS link
  FROM (SELECT page_id, url, regexp_extract_all(html, '<li><a href="([^"]*)">', 1) AS hrefs,
               regexp_extract_all(html, '<li><a href="[^"]*">(.*?)</a>', 1) AS texts FROM pages)
"""


def raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_pages(spark, f"{sf_dir}/pages.parquet")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(parse_pages(raw_pages(spark, sf_dir), LINK_RULES), LINK_RULES)


@query(LINKS)
def nav_links(spark, sf_dir):
    return links(spark, sf_dir)


@query(f"SELECT DISTINCT text, link FROM ({LINKS})")
def nav_links_distinct(spark, sf_dir):
    names = LINK_RULES.names
    return distinct_records(clean_records(links(spark, sf_dir), names), names)


@query(
    f"""SELECT text, link, p.page_id AS first_page, p.card_no AS first_card FROM
    (SELECT text, link, min({{'page_id': page_id, 'card_no': card_no}}) AS p FROM ({LINKS}) GROUP BY text, link)"""
)
def nav_links_first(spark, sf_dir):
    first = distinct_records(links(spark, sf_dir), LINK_RULES.names, first=["page_id", "card_no"])
    return first.withColumnsRenamed({"page_id": "first_page", "card_no": "first_card"})


@query(
    """SELECT page_id, array_to_string(regexp_extract_all(html, '<li><a href="([^"]*)">', 1), ', ') AS hrefs,
    array_to_string(list_transform(regexp_extract_all(html, '<li><a href="[^"]*">(.*?)</a>', 1),
      lambda t: trim(regexp_replace(replace(t, '&amp;', '&'), '\\s+', ' ', 'g'))), ', ') AS texts FROM pages"""
)
def nav_joined(spark, sf_dir):
    rules = PageRules(
        "nav",
        (
            FieldRule("hrefs", "li a", "href", collect_all=True, join_with=", "),
            FieldRule("texts", "li a", collect_all=True, join_with=", "),
        ),
    )
    return records(parse_pages(raw_pages(spark, sf_dir), rules), rules).select("page_id", "hrefs", "texts")


@query(
    r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '<h1>(.*?)</h1>', 1, 's'),
    '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS heading FROM pages"""
)
def article_heading(spark, sf_dir):
    rules = PageRules("article", (FieldRule("heading", "h1"),))
    return records(parse_pages(raw_pages(spark, sf_dir), rules), rules).select("page_id", "heading")


@query("""SELECT page_id, regexp_extract(html, '<meta charset="([^"]*)"', 1) AS charset FROM pages""")
def page_charset(spark, sf_dir):
    rules = PageRules("head", (FieldRule("charset", "meta", "charset"),))
    return records(parse_pages(raw_pages(spark, sf_dir), rules), rules).select("page_id", "charset")


@query(
    r"""SELECT page_id, hrefs[1] AS first_child, hrefs[len(hrefs)] AS last_child,
      array_to_string(list_filter(hrefs, lambda h, i: i % 2 = 0), '|') AS even,
      array_to_string(list_filter(hrefs, lambda h, i: i > 2), '|') AS after_second,
      array_to_string(list_filter(hrefs, lambda h: starts_with(h, '/t')), '|') AS starts_with_t,
      array_to_string(list_filter(hrefs, lambda h: NOT contains(h, 'e')), '|') AS without_e,
      CASE WHEN html LIKE '%<div class="ad">%</div><article>%' THEN 'en' ELSE '' END AS after_ad
    FROM (SELECT page_id, html, regexp_extract_all(html, '<li><a href="([^"]*)">', 1) AS hrefs FROM pages)"""
)
def selector_forms(spark, sf_dir):
    """One column per selector form, on whole pages."""
    nav = "nav > ul > li"
    rules = PageRules(
        "body",
        (
            FieldRule("first_child", f"{nav}:first-child > a", "href"),
            FieldRule("last_child", f"{nav}:last-child a", "href"),
            FieldRule("even", f"{nav}:nth-child(2n) a", "href", collect_all=True, join_with="|"),
            FieldRule("after_second", f"{nav} + li ~ li a", "href", collect_all=True, join_with="|"),
            FieldRule("starts_with_t", 'nav a[href^="/t"]', "href", collect_all=True, join_with="|"),
            FieldRule("without_e", "nav a:not([href*=e])", "href", collect_all=True, join_with="|"),
            FieldRule("after_ad", "div.ad + article, nav.missing"),
        ),
    )
    names = [name for name in rules.names if name != "after_ad"]
    found = F.when(F.col("after_ad") != "", "en").otherwise("").alias("after_ad")
    return records(parse_pages(raw_pages(spark, sf_dir), rules), rules).select("page_id", *names, found)


@query(
    f"""SELECT page_id, 'none' AS rule, 'no element matches table' AS error FROM pages
    UNION ALL SELECT page_id, 'strict', CASE WHEN count(text) = 0 THEN 'no element matches nav li'
      ELSE 'every card lacks a required field' END FROM pages LEFT JOIN ({LINKS}) USING (page_id) GROUP BY page_id"""
)
def page_errors(spark, sf_dir):
    pages = raw_pages(spark, sf_dir)
    none = PageRules("table", (FieldRule("cell", "td"),))
    lost = PageRules("nav li", (FieldRule("mark", "i", required=True),))
    first = page_facts(parse_pages(pages, none), none).select("page_id", F.lit("none").alias("rule"), "error")
    second = page_facts(parse_pages(pages, lost), lost, strict=True)
    return first.unionByName(second.select("page_id", F.lit("strict").alias("rule"), "error"))


@query(
    """SELECT url, max(page_id) AS page_id FROM (SELECT page_id, url FROM pages UNION ALL
    SELECT page_id + 10000000, url FROM pages WHERE page_id % 3 = 0) GROUP BY url""",
    name="latest_pages",
)
def latest_snapshot(spark, sf_dir):
    """Every third page was fetched a second time later on."""
    pages = raw_pages(spark, sf_dir)
    later = pages.filter("page_id % 3 = 0").withColumn("page_id", F.col("page_id") + 10_000_000)
    return latest_pages(pages.unionByName(later)).select("url", "page_id")


@query(
    """SELECT url, CASE WHEN page_id % 3 = 0 THEN page_id % 7 + 100 ELSE page_id % 7 END AS page_id,
      md5(html || CASE WHEN page_id % 3 = 0 THEN '<!-- again -->' ELSE '' END) AS body FROM pages"""
)
def latest_bodies(spark, sf_dir):
    """Ids are shared by many URLs, every third page was fetched again, every fifth is stored twice."""
    pages = raw_pages(spark, sf_dir)
    first = pages.withColumn("page_id", F.col("page_id") % 7)
    again = pages.filter("page_id % 3 = 0").select(
        (F.col("page_id") % 7 + 100).alias("page_id"), "url", F.concat("html", F.lit("<!-- again -->")).alias("html")
    )
    twice = pages.filter("page_id % 5 = 0").withColumn("page_id", F.col("page_id") % 7)
    newest = latest_pages(first.unionByName(again).unionByName(twice))
    return newest.select("url", "page_id", F.md5("html").alias("body"))


@query(f"SELECT page_id, url AS source_url, card_no AS source_card_no, link AS url, text AS card_no FROM ({LINKS})")
def field_names(spark, sf_dir):
    """Fields that go by the names of provenance columns."""
    rules = PageRules("nav li", (FieldRule("card_no", "a", required=True), FieldRule("url", "a", "href", "url")))
    return records(parse_pages(raw_pages(spark, sf_dir), rules), rules)


# Rows as a careless earlier step leaves them: padded copies, blanks, nulls, a column too many.
DIRTY = f"""
  SELECT text, link FROM ({LINKS})
  UNION ALL SELECT text, link FROM ({LINKS}) WHERE page_id % 3 = 0
"""


def dirty_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = links(spark, sf_dir)
    pad = F.when(F.col("page_id") % 3 == 0, F.struct(F.concat(F.lit("  "), "text", F.lit("\t")).alias("text"), "link"))
    blank = F.when(F.col("page_id") % 5 == 0, F.struct(F.lit("  ").alias("text"), F.lit(None).alias("link")))
    copies = F.filter(F.array(F.struct("text", "link"), pad, blank), lambda row: row.isNotNull())
    return rows.select(F.explode(copies).alias("row"), "card_no").select("row.*", F.col("card_no").alias("extra"))


@query(f"SELECT text, link, '' AS note FROM ({DIRTY})", name="clean_records")
def clean_rows(spark, sf_dir):
    return clean_records(dirty_links(spark, sf_dir), ["text", "link", "note"])


@query(f"SELECT count(*) - count(DISTINCT {{'t': text, 'l': link}}) AS duplicates FROM ({DIRTY})")
def duplicate_rows(spark, sf_dir):
    return duplicate_counts(clean_records(dirty_links(spark, sf_dir), LINK_RULES.names), LINK_RULES.names)


@query(f"SELECT text, link FROM ({LINKS}) EXCEPT SELECT text, link FROM ({LINKS}) WHERE page_id % 2 = 0")
def append_new_only(spark, sf_dir):
    """An earlier run wrote the pages with an even number."""
    names = LINK_RULES.names
    target = new_dir(spark, "append")
    write_records(links(spark, sf_dir).filter("page_id % 2 = 0"), target, names)
    return new_records(clean_records(dirty_links(spark, sf_dir), names), read_output(spark, target, names), names)


@query(f"SELECT DISTINCT text, link FROM ({LINKS})")
def csv_roundtrip(spark, sf_dir):
    """Write with a byte order mark, append everything again, read back."""
    names = LINK_RULES.names
    target = new_dir(spark, "csv")
    write_records(links(spark, sf_dir), target, names)
    write_records(dirty_links(spark, sf_dir), target, names, append=True)
    return read_output(spark, target, names)


@query(f"SELECT DISTINCT text, link FROM ({LINKS})")
def stream_records(spark, sf_dir):
    """The page file as a stream into a CSV folder."""
    target = new_dir(spark, "stream")
    pages = streams.table_stream(spark, f"{sf_dir}/pages.parquet")
    rows = streams.stream_records(pages, LINK_RULES)
    streams.write_stream(rows, f"{target}/csv", f"{target}/checkpoint").awaitTermination()
    return read_output(spark, f"{target}/csv", LINK_RULES.names)


@query(
    f"""SELECT DISTINCT text, link FROM ({LINKS})
    EXCEPT SELECT text, link FROM ({LINKS}) WHERE page_id % 3 = 0"""
)
def stream_append(spark, sf_dir):
    """The page file as a stream into a CSV folder that has a third of the pages' links already: what it adds."""
    target, names = new_dir(spark, "stream-append"), LINK_RULES.names
    old = records(parse_pages(raw_pages(spark, sf_dir).filter("page_id % 3 = 0"), LINK_RULES), LINK_RULES)
    write_records(old, f"{target}/old", names)
    known = read_output(spark, f"{target}/old", names)
    pages = streams.table_stream(spark, f"{sf_dir}/pages.parquet")
    rows = streams.unwritten_records(streams.stream_records(pages, LINK_RULES), known, names)
    streams.write_stream(rows, f"{target}/new", f"{target}/checkpoint").awaitTermination()
    return read_output(spark, f"{target}/new", names).select("text", "link")


@query(f"SELECT page_id, count(text) AS kept FROM pages LEFT JOIN ({LINKS}) USING (page_id) GROUP BY page_id")
def stream_observer(spark, sf_dir):
    """Each batch's pages are handed over as they are processed."""
    target = new_dir(spark, "observer")

    def on_pages(batch: DataFrame, number: int) -> None:
        batch.select("page_id", "kept").write.mode("overwrite").parquet(f"{target}/pages/batch={number}")

    pages = streams.table_stream(spark, f"{sf_dir}/pages.parquet")
    streams.observe_pages(pages, LINK_RULES, on_pages, f"{target}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{target}/pages").select("page_id", "kept")


@query(
    r"""SELECT 'page' AS source, url, CASE WHEN regexp_matches(url, '[?&]page=[0-9]+') THEN
      regexp_extract(url, '^(.*[?&]page=)[0-9]+', 1) || (regexp_extract(url, '[?&]page=([0-9]+)', 1)::BIGINT + 1)
      || regexp_extract(url, '[?&]page=[0-9]+(.*)$', 1) END AS bumped FROM pages
    UNION ALL SELECT 'order', 'https://shop.example/o?sort=price&Page=00' || o_custkey || '&offset=' || o_orderkey || 'x&page=#p=1',
      'https://shop.example/o?sort=price&Page=' || (o_custkey - 1) || '&offset=' || (o_orderkey - 1) || 'x&page=#p=1' FROM orders""",
    name="bump_page",
)
def bumped_pages(spark, sf_dir):
    url = F.col("url")
    stored = read(spark, sf_dir, "pages").select(F.lit("page").alias("source"), "url", bump_page(url).alias("bumped"))
    made = F.format_string(
        "https://shop.example/o?sort=price&Page=00%s&offset=%sx&page=#p=1",
        F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string"),
    )
    orders = read(spark, sf_dir, "orders").select(F.lit("order").alias("source"), made.alias("url"))
    return stored.unionByName(orders.withColumn("bumped", bump_page(url, -1)))


LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, price, CASE WHEN odd THEN '' ELSE price END AS "float",
      CASE WHEN odd THEN '' ELSE split_part(price, '.', 1) END AS "int" FROM (
      SELECT *, k % 19 = 0 AS odd, CASE WHEN k % 19 = 0 THEN units || '-' || part
        WHEN k % 23 = 0 THEN '-' || units || '.' || part WHEN k % 17 = 0 THEN ''
        WHEN k % 4 = 3 THEN units ELSE units || '.' || part END AS price
      FROM (SELECT *, (cents // 100)::VARCHAR AS units, lpad((cents % 100)::VARCHAR, 2, '0') AS part FROM (
        SELECT l_orderkey, l_linenumber, l_partkey, l_orderkey + l_partkey + l_linenumber AS k,
               round(l_extendedprice * 100)::BIGINT AS cents FROM lineitem)))""",
    name="transforms",
)
def price_transforms(spark, sf_dir):
    """Line prices in several notations, some with a sign or as a range."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    units, part = (cents / 100).cast("long").cast("string"), F.lpad((cents % 100).cast("string"), 2, "0")
    key = F.col("l_orderkey") + F.col("l_partkey") + F.col("l_linenumber")
    raw = (
        F.when(key % 19 == 0, F.concat(F.lit("от "), units, F.lit(" - "), part, F.lit(" €")))
        .when(key % 23 == 0, F.concat(F.lit("-"), units, F.lit(","), part, F.lit(" руб.")))
        .otherwise(price_text(key, cents))
    )
    rows = spread(read(spark, sf_dir, "lineitem").select(*LINE)).select("l_orderkey", "l_linenumber", "l_partkey", raw.alias("raw"))
    raw = F.col("raw")
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        price(raw).alias("price"), number(raw).alias("float"), whole(raw).alias("int"),
    )


SQL_SPACE = (
    r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)


@query(
    rf"""SELECT doc_id, trim(regexp_replace(text, '[{SQL_SPACE}]+', ' ', 'g')) AS collapsed,
    regexp_replace(regexp_replace(text, '^[{SQL_SPACE}]+', ''), '[{SQL_SPACE}]+$', '') AS stripped FROM documents""",
    name="transforms_text",
)
def text_transforms(spark, sf_dir):
    padded = F.concat(F.lit(" \n"), F.col("text"), F.lit("  \x1f"))
    docs = spread(read(spark, sf_dir, "documents").select("doc_id", "text"))
    docs = docs.select("doc_id", padded.alias("raw"))
    return docs.select("doc_id", text(F.col("raw")).alias("collapsed"), strip(F.col("raw")).alias("stripped"))
