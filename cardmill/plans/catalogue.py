"""Catalogue pages rendered by Spark from the ``part`` table.

One brand is one crawl; its parts, in key order, fill pages of 20 cards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.extract import page_facts, parse_pages
from ..operators.rules import FieldRule, PageRules, PagerRules
from ..session import materialise, new_dir
from ..sources.page_store import PageStore, as_log, write_store
from ..sources.pages import spread

PER_PAGE = 20
SITE = "https://lots.example"

CARD_RULES = PageRules(
    "tr.lot",
    (
        FieldRule("title", "a.what", required=True),
        FieldRule("price", "td.sum", transform="price"),
        FieldRule("link", "a.what", "href", "url"),
        FieldRule("rating", "meta.mark", "content", "float"),
    ),
)
PAGER_RULES = PagerRules("a.onward", "a.leaf")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def numbered(df: DataFrame, group: str, key: str, width: int = 65536) -> DataFrame:
    """``rn``: place of each row in its group by an integer key.

    Ranks are taken in key ranges and shifted by the size of the ranges before,
    so that a group with most of the rows is not sorted by one task.
    """
    ranged = df.withColumn("__range", F.floor(F.col(key) / width))
    before = Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(group, "__range").agg(F.count("*").alias("__size"))
    shifts = sizes.select(
        group, "__range",
        F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__shift"),
        F.sum("__size").over(Window.partitionBy(group)).alias("group_size"),
    )
    place = F.row_number().over(Window.partitionBy(group, "__range").orderBy(key))
    ranked = ranged.withColumn("__place", place).join(shifts, [group, "__range"])
    return ranked.withColumn("rn", F.col("__shift") + F.col("__place")).drop("__range", "__shift", "__place")


def price_text(key: Column, cents: Column) -> Column:
    """An amount in one of four notations, or a note instead of a price."""
    units = (cents / 100).cast("long").cast("string")
    part = F.lpad((cents % 100).cast("string"), 2, "0")
    split = r"(?<=\d)(?=(\d{3})+$)"
    notation = key % 4
    return (
        F.when(key % 17 == 0, F.lit("ask the seller"))
        .when(notation == 0, F.concat(F.regexp_replace(units, split, " "), F.lit(","), part, F.lit(" Kč")))
        .when(notation == 1, F.concat(F.regexp_replace(units, split, "."), F.lit(","), part, F.lit(" €")))
        .when(notation == 2, F.concat(F.lit("$"), F.regexp_replace(units, split, ","), F.lit("."), part))
        .otherwise(F.regexp_replace(units, split, ","))
    )


def _card() -> Column:
    key = F.col("p_partkey")
    cents = F.round(F.col("p_retailprice") * 1300).cast("long")
    title = F.format_string(
        '<a class="what" href="/lot/%s">\n  %s </a>', key.cast("string"), F.replace(F.col("p_name"), F.lit(" "), F.lit("  "))
    )
    return F.concat(
        F.lit('<tr class="wide lot"><th scope="row">'),
        F.when(key % 13 == 0, F.lit("<i>unnamed lot</i>")).otherwise(title),
        F.lit('<td class="sum">'), price_text(key, cents), F.lit("</td>"),
        F.lit('<td><meta class="mark" content="'), (F.col("p_size") % 3 + 3).cast("string"), F.lit('.5">'),
        F.lit('<img src="/img/'), key.cast("string"), F.lit('.png" alt="part">'),
        F.lit('<ol class="kinds"><li>'), F.col("p_type"), F.lit("<li>"), F.col("p_brand"), F.lit("</ol></tr>"),
    )


def brand_no(brand: Column) -> Column:
    return F.regexp_extract(brand, r"(\d+)$", 1).cast("long")


def page_link(brand: Column, page: Column) -> Column:
    return F.concat(F.lit("/b"), brand_no(brand).cast("string"), F.lit("?page="), page.cast("string"))


_RENDERED: dict[tuple, DataFrame] = {}


def catalogue_pages(spark: SparkSession, sf_dir: str, faults: bool = False, loops: bool = False) -> DataFrame:
    """The stored catalogue: rendered once per session, then read as a table."""
    key = (spark.sparkContext.applicationId, sf_dir, faults, loops)
    if key not in _RENDERED:
        pages = render(read(spark, sf_dir, "part"), faults, loops)
        _RENDERED[key] = materialise(pages, "catalogue")
    return _RENDERED[key]


def render(part: DataFrame, faults: bool = False, loops: bool = False) -> DataFrame:
    """``brand, page_no, page_id, url, html``.

    With ``faults`` page 3 of a brand, by brand number modulo 4: has no cards
    (0), only cards without title (1), or is not stored (2). With ``loops`` the
    last page links back to page 2.
    """
    parts = numbered(part, "p_brand", "p_partkey")
    cards = parts.select(
        F.col("p_brand").alias("brand"),
        F.floor((F.col("rn") - 1) / PER_PAGE + 1).alias("page_no"),
        F.ceil(F.col("group_size") / PER_PAGE).alias("pages"),
        F.struct("rn", _card().alias("html")).alias("card"),
    )
    # A group is one page: 20 cards.
    pages = cards.groupBy("brand", "page_no", "pages").agg(F.array_sort(F.collect_list("card")).alias("cards"))
    brand, page, last = F.col("brand"), F.col("page_no"), F.col("pages")
    body = F.array_join(F.transform("cards", lambda c: c["html"]), "\n")
    if faults:
        kind = F.when(page == 3, brand_no(brand) % 4)
        broken = F.lit('<tr class="lot"><td class="sum">17 €</td></tr>')
        pages = pages.filter(F.coalesce(kind != 2, F.lit(True)))
        body = F.when(kind == 0, F.lit("<caption>sold out</caption>")).when(kind == 1, broken).otherwise(body)

    def link(number: Column) -> Column:
        return F.concat(
            F.lit('<a class="leaf" href="'), page_link(brand, number), F.lit('">'), number.cast("string"),
            F.lit("</a>"),
        )

    near = F.sequence(F.greatest(page - 2, F.lit(1)), F.least(page + 2, last))
    pager = F.array_join(F.transform(F.array_distinct(F.concat(F.array(F.lit(1).cast("long")), near)), link), " ")
    onward = F.when(page < last, page + 1)
    if loops:
        onward = F.coalesce(onward, F.least(F.lit(2).cast("long"), last))
    arrow = F.coalesce(
        F.concat(F.lit('<a class="onward" href="'), page_link(brand, onward), F.lit('">more lots</a>')),
        F.lit('<a class="onward disabled" href="?">more lots</a>'),
    )
    html = F.concat(
        F.lit('<!DOCTYPE html>\n<meta charset="utf-8"><title>Lots of '), brand, F.lit("</title><h1>"), brand,
        F.lit('</h1><table class="stock">'), body, F.lit('</table><p class="leaves">'), pager, F.lit(" "), arrow,
    )
    return pages.select(
        "brand", "page_no", (brand_no(brand) * 1_000_000_000 + page).alias("page_id"),
        F.concat(F.lit(SITE), page_link(brand, page)).alias("url"), html.alias("html"),
    )


def catalogue_log(pages: DataFrame) -> DataFrame:
    """A fetch log: the first page of a brand is busy twice."""
    busy = F.struct(F.lit(503).alias("status"), F.lit("busy").alias("body"))
    page = F.struct(F.lit(200).alias("status"), F.col("html").alias("body"))
    tries = F.when(F.col("page_no") == 1, F.array(busy, busy, page)).otherwise(F.array(page))
    rows = pages.select("url", F.posexplode(tries).alias("attempt", "response"))
    return rows.select(
        "url",
        (F.col("attempt") + 1).alias("attempt"),
        "response.status",
        F.lit("text/html; charset=utf-8").alias("content_type"),
        "response.body",
        F.lit(None).cast("string").alias("net_error"),
    )


def catalogue_robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue's robots body, one line per brand closed to robots."""
    brands = brand_crawls(spark, sf_dir, "none", 1)
    number = F.regexp_extract("crawl_id", r"(\d+)$", 1).cast("long")
    closed = F.collect_list(F.when(number % 6 == 5, F.concat(F.lit("Disallow: /b"), number.cast("string"), F.lit("?page="))))
    return brands.groupBy(F.lit("https://lots.example").alias("origin")).agg(
        F.lit(200).alias("robots_status"),
        F.concat(F.lit("User-agent: *\n"), F.array_join(F.array_sort(closed), "\n")).alias("body"),
    )


_STORES: dict[tuple, PageStore] = {}


def catalogue_store(spark: SparkSession, sf_dir: str, logged: bool = True, **options: bool) -> PageStore:
    """The catalogue's pages, or their fetch log, in a store that is built once per session."""
    key = (spark.sparkContext.applicationId, sf_dir, logged, *sorted(options.items()))
    if key not in _STORES:
        pages = catalogue_pages(spark, sf_dir, **options)
        _STORES[key] = write_store(catalogue_log(pages) if logged else as_log(pages), new_dir(spark, "store"))
    return _STORES[key]


def catalogue_parsed(spark: SparkSession, sf_dir: str, rules: PageRules = CARD_RULES, **options: bool) -> DataFrame:
    pages = catalogue_pages(spark, sf_dir, **options)
    return parse_pages(spread(pages), rules, PAGER_RULES, keep=("brand", "page_no", "page_id", "url"))


def catalogue_facts(spark: SparkSession, sf_dir: str, **options: bool) -> DataFrame:
    return page_facts(catalogue_parsed(spark, sf_dir, **options), CARD_RULES)


def brand_crawls(
    spark: SparkSession, sf_dir: str, mode: str, max_pages: int | None = None, stop_on_error: bool = True
) -> DataFrame:
    """One crawl per brand of the part table, starting at its first page.

    The limit is taken from the data, two pages more than the longest brand has, unless
    one is given.
    """
    parts = read(spark, sf_dir, "part")
    if max_pages is None:
        longest = parts.groupBy("p_brand").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
        max_pages = -(-longest // PER_PAGE) + 2
    brands = parts.select("p_brand").distinct()
    brand = F.col("p_brand")
    base = F.concat(F.lit(f"{SITE}/b"), brand_no(brand).cast("string"), F.lit("?page="))
    return brands.select(
        brand.alias("crawl_id"),
        F.concat(base, F.lit("1")).alias("start_url"),
        F.lit(mode).alias("mode"),
        F.concat(base, F.lit("{page}")).alias("url_template"),
        F.lit(1).cast("long").alias("start_page"),
        F.lit(max_pages).cast("long").alias("max_pages"),
        F.lit(stop_on_error).alias("stop_on_error"),
    )
