import pytest

from cardmill import FieldRule, PageRules, PagerRules
from cardmill.operators.extract import page_facts, parse_pages, records
from cardmill.sources.pages import latest_pages, spread

# A library's shelf: a full entry with ragged blanks and subjects, one without a link, one with a signature only.
PAGE = """<table id="shelf"><caption>Shelf 12</caption>
 <tr class="book"><td class="sig">\n  QA 76\t.9 \n<td><a class="t" href="?book=76"> Sorting   and\nsearching </a>
  <td class="fee">CHF 3'050.20 <del>CHF 9'999.00</del><td><meta name="stars" content="3.75"><i class="sub">trees</i> <i class="sub">heaps</i>
 <tr class="book"><td class="sig">PN 1<td><b class="t">On &amp; off</b><td class="fee">free
 <tr class="book"><td class="sig">Z 9
</table>"""
URL = "https://library.test/shelves/12?sort=sig"
TITLE = FieldRule("sig", "td.sig", required=True)
PRICE = FieldRule("fee", "td.fee", transform="price")
LINK = FieldRule("link", "a.t", "href", "url")
RATING = FieldRule("stars", "meta[name=stars]", "content", "float")


def parse(spark, html, *fields, container="tr.book", pager=None, url=URL):
    rules = PageRules(container, fields)
    pages = spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")
    return parse_pages(pages, rules, pager), rules


def rows(spark, html, *fields, **options):
    parsed, rules = parse(spark, html, *fields, **options)
    return [tuple(r)[3:] for r in records(parsed, rules).orderBy("card_no").collect()]


def facts(spark, html, *fields, strict=False, **options):
    parsed, rules = parse(spark, html, *fields, **options)
    return page_facts(parsed, rules, strict=strict).first()


def test_all_fields(spark):
    assert rows(spark, PAGE, TITLE, PRICE, LINK, RATING) == [
        ("QA 76 .9", "3050.209999.00", "https://library.test/shelves/12?book=76", "3.75"),
        ("PN 1", "", "", ""),
        ("Z 9", "", "", ""),
    ]
    counted = facts(spark, PAGE, TITLE, PRICE, LINK, RATING)
    assert (counted.found, counted.kept, counted.skipped, counted.empty_fields, counted.error) == (3, 3, 0, 6, None)


def test_required_is_checked_after_the_transform(spark):
    fee = FieldRule("fee", "td.fee", transform="price", required=True)
    counted = facts(spark, PAGE, fee)
    assert (counted.found, counted.kept, counted.skipped) == (3, 1, 2)
    # Two amounts in one text are no number.
    fee = FieldRule("fee", "td.fee", transform="float", required=True)
    assert facts(spark, PAGE, fee).kept == 0


def test_no_container_is_an_error_and_the_page_stays(spark):
    counted = facts(spark, PAGE, TITLE, container="tr.journal")
    assert counted.found == 0 and "tr.journal" in counted.error


def test_strict(spark):
    missing = FieldRule("isbn", "td.isbn", required=True)
    assert facts(spark, PAGE, missing).error is None
    assert "required" in facts(spark, PAGE, missing, strict=True).error


def test_lists(spark):
    subjects = FieldRule("subjects", "i.sub", collect_all=True, join_with=" / ")
    assert rows(spark, PAGE, subjects)[0] == ("trees / heaps",)
    html = '<tr class="book"><td><img src="a.png" alt="A"><img alt="B"><img><img src="c.png">'
    images = FieldRule("images", "img", "src", collect_all=True, join_with=";")
    assert rows(spark, html, images) == [("a.png;c.png",)]


def test_cards_within_cards(spark):
    html = "<section class='box'>outer<p class='tag'>a<section class='box'>inner<p class='tag'>b"
    tags = FieldRule("tags", "p.tag", collect_all=True, join_with="+", required=True)
    assert rows(spark, html, tags, container=".box") == [("a+b",), ("b",)]
    inner = FieldRule("box", ".box", required=True)
    counted = facts(spark, html, inner, container=".box")
    assert (counted.found, counted.kept) == (2, 1)


def test_ancestors_may_lie_outside_the_card(spark):
    html = '<main class="m"><div class="card"><b>x</b></div></main>'
    assert rows(
        spark, html, FieldRule("a", ".m b"), FieldRule("b", ".card b"), FieldRule("c", ".card .card b"), container=".card"
    ) == [("x", "x", "")]


@pytest.mark.parametrize(
    ("html", "url", "expected"),
    [
        ('<a class="n" href="/c?page=2">', "https://x.test/c?page=1", "https://x.test/c?page=2"),
        ('<a class="n disabled" href="/c?page=2">', "https://x.test/c", None),
        ('<a class="n not-disabled" href="?p=2">', "https://x.test/c?p=1#f", "https://x.test/c?p=2"),
        ('<span class="n">', "https://x.test/c", None),
        ('<a class="n" href=" # ">', "https://x.test/c", None),
        ('<a class="n" href="../page/2?page=2">', "https://x.test/catalog/index.html", "https://x.test/page/2?page=2"),
        ('<a class="n" href="//y.test/d">', "https://x.test/c", "https://y.test/d"),
        ('<a class="n" href="http://[bad">', "https://x.test/c", None),
    ],
)
def test_next_link(spark, html, url, expected):
    parsed, _ = parse(spark, html, TITLE, pager=PagerRules("a.n, span.n"), url=url)
    assert parsed.first().next_url == expected


def test_pager_links(spark):
    html = '<a class="p" href="/1"><a class="p" href="#"><a class="p"><a class="p" href="/2"><a class="p" href="/1">'
    parsed, _ = parse(spark, html, TITLE, pager=PagerRules(None, "a.p"), url="https://x.test/")
    assert parsed.first().pager_urls == ["https://x.test/1", "https://x.test/2", "https://x.test/1"]


def test_bad_address_voids_the_page_only(spark):
    html = '<p class="card"><a href="http://[bad">'
    counted = facts(spark, html, FieldRule("link", "a", "href", "url"), container=".card")
    assert counted.found == 0 and counted.error


def test_null_and_empty_pages(spark):
    pages = spark.createDataFrame([(1, URL, None), (2, URL, "")], "page_id long, url string, html string")
    rules = PageRules(".card", (TITLE,))
    assert [(r.found, r.error) for r in page_facts(parse_pages(pages, rules), rules).collect()] == [(0, "empty response")] * 2


def test_many_pages_keep_their_cards(spark):
    pages = spark.range(2000).selectExpr(
        "id as page_id", "concat('https://x.test/', id) as url",
        "concat_ws('', transform(sequence(1, 1 + id % 5), i -> concat('<p class=card><a href=', id, '-', i, '></a>'))) as html",
    )
    rules = PageRules("p.card", (FieldRule("link", "a", "href"),))
    rows = records(parse_pages(pages, rules), rules)
    assert rows.count() == 6000
    assert rows.filter("link <> concat(page_id, '-', card_no)").count() == 0


def test_bad_rules_fail_at_plan_time(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    with pytest.raises(ValueError):
        parse_pages(pages, PageRules("a:hover", (TITLE,)))
    with pytest.raises(ValueError):
        FieldRule("x", "a", transform="magic")
    with pytest.raises(ValueError):
        PageRules("a", (TITLE, TITLE))


@pytest.mark.parametrize("limit", [200_000, 0])
def test_latest_copy_of_each_url(spark, monkeypatch, limit):
    """Ids are shared between URLs, repeat, or are missing; exactly one copy of each URL stays."""
    monkeypatch.setattr("cardmill.operators.joins.BROADCAST_ROWS", limit)
    rows = [(1, "a", "old"), (3, "a", "new"), (1, "b", "only"), (4, "a", "newest"), (7, "t", "x"), (7, "t", "y"), (2, "t", "z"),
            (None, "n", "no id"), (5, "n", "id"), (None, "m", "p"), (None, "m", "q"), (9, None, "r"), (9, None, "s")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {}
    for row in latest_pages(pages).collect():
        got.setdefault(row.url, []).append(row.html)
    assert got["a"] == ["newest"] and got["b"] == ["only"] and got["n"] == ["id"]
    assert got["t"] in (["x"], ["y"]) and got["m"] in (["p"], ["q"]) and sorted(got[None]) == ["r", "s"]
    assert latest_pages(pages.limit(0)).collect() == []


def test_html_is_scanned_once_and_not_shuffled(spark, tmp_path):
    pages = spark.range(100).selectExpr("id as page_id", "concat('u', id) as url", "'<p>x' as html", "1 as other")
    pages.repartition(8).write.parquet(str(tmp_path / "p"))
    rules = PageRules("p", (FieldRule("x", "b"),))
    table = spread(spark.read.parquet(str(tmp_path / "p")))
    plan = records(parse_pages(table, rules), rules)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1
    assert "ReadSchema: struct<page_id:bigint,url:string,html:string>" in plan
