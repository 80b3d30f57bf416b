"""Main text of pages: markup of many kinds, wrappers, and the generator's pages against a plain reading."""

import html as entities
import random
import re

import duckdb
import pytest

from cardmill.llm import wrappers
from cardmill.llm.wrappers import Wrapper, extract_text, infer_wrappers, main_text


def alone(html):
    return main_text(html, set(), None)


PARTS = """<header class="site"><a href="/">Home</a></header><nav>Menu</nav><div class="cookie-notice">We use cookies</div>
<aside>Side</aside><form><label>Name</label><input value="x"><button>Send</button></form>"""


@pytest.mark.parametrize("html, text", [
    ("", ""),
    ("just text", "just text"),
    ("<p>one<p>two", "one two"),
    (f"<body>{PARTS}<article><h1>T &amp; U</h1><p>a<b>b</b>c <i>d</i>\n\n e&nbsp;f</p></article><footer>F</footer>", "T & U abc d e f"),
    ("<article><header><h1>Head</h1></header><p>x</p><div class='comments'><p>no</p></div></article>", "Head x"),
    ("<article>story of all<p>more</p></article><section id='comments'><article class='comment'><p>" + "long " * 99 + "</p></article></section>", "story of all more"),
    ("<body><div class=sidebar>s</div><div id='content'><h2>H</h2><ul><li>1<li>2</ul><table><tr><td>a<td>b</table></div></body>", "H 1 2 a b"),
    ("<main><p>in</p></main><p>out</p>", "in"),
    ("<article><p>a<script>var x='</p>'</script>b<style>p{}</style><!-- c --> d<br>e</p></article>", "ab d e"),
    ("<article><p>&#x41;&eacute;&lt;b&gt; &bogus; &amp;amp;</p></article>", "Aé<b> &bogus; &amp;"),
    ("<article></article><p>elsewhere</p>", "elsewhere"),
    ("<html><head><title>T</title></head><body></body></html>", ""),
    ("<div>" * 5000 + "deep" + "</div>" * 5000, "deep"),
    ("<article><p>open <b>bold <a href='x>y'>link</p><p>next", "open bold link next"),
    ("<article><div class='ad'>buy</div><p>x</p><div class='social-share'>tweet</div><p hidden>h</p></article>", "x"),
    ("<article><p>" + "word " * 200_000 + "</p></article>", ("word " * 200_000).strip()),
])
def test_markup(html, text):
    assert alone(html) == text


def page(k, extra="", items=2):
    cards = "".join(f"<li>item {k} {i}</li>" for i in range(items))
    return f"<html><body><div class='x'><div class='top'>Our shop</div><div class='m'><h2>Title {k}</h2><p>Share this page</p><p>Text {k} runs on and on, {k} times.</p>{extra}<ul>{cards}</ul></div><div class='low'>Call us</div></div></body></html>"


def test_wrapper_of_aligned_pages():
    whole = Wrapper.of(page(1))
    for k in range(2, 9):
        whole = whole.merge(Wrapper.of(page(k, "<h3>extra</h3>" if k % 2 else "", k)))
    fixed, inner = Wrapper.load(whole.dump()).facts()
    assert whole.pages == 8 and inner[-1] == "div.m"
    assert {text for _, text in fixed} >= {"Our shop", "Call us"}
    text = main_text(page(20), fixed, inner)
    assert text == "Title 20 Share this page Text 20 runs on and on, 20 times. item 20 0 item 20 1"


@pytest.mark.parametrize("count", [4, 5, 8, 50])
@pytest.mark.parametrize("around", ["article", "main", "div role=main", "div id=content"])
def test_parts_of_the_text_that_pages_share_stay(count, around):
    """A heading, a byline, a quote and a table that all pages have are the article's, however many pages there are."""
    parts = "<h2>Ingredients</h2><p class='by'>By Jane Roe</p><blockquote>Measure <b>twice</b></blockquote><ul><li>salt</ul><table><tr><td>1 cup</table>"
    tag = around.split()[0]
    pages = [f"<body><div class='top'>Our shop</div><{around}><h1>Recipe {k}</h1>{parts}<p>Take {k} eggs and more.</p></{tag}><div class='low'>Call us</div></body>" for k in range(count)]
    found = main_text(pages[3], *whole_of(pages).facts())
    wanted = "Recipe 3 Ingredients By Jane Roe Measure twice salt 1 cup Take 3 eggs and more."
    assert found == (wanted if count >= 5 or tag != "div" or "role" in around else f"Our shop {wanted} Call us")


def test_boxes_of_a_region_without_tags_go():
    """Outside article and main, a box that says the same on all pages is the template's."""
    pages = [f"<body><div class='m'><h1>Story {k}</h1><div class='x1'>Read our {'rules ' * 20}</div><p>Body {k} is long enough.</p></div></body>" for k in range(9)]
    assert main_text(pages[3], *whole_of(pages).facts()) == "Story 3 Body 3 is long enough."
    inside = [page.replace("<div class='m'>", "<article>").replace("</p></div>", "</p></article>") for page in pages]
    assert "Read our rules" in main_text(inside[3], *whole_of(inside).facts())


@pytest.mark.parametrize("name, stays", [
    ("related-work", True), ("share-prices", True), ("social-science", True), ("notice-period", True), ("ad", False),
    ("ad-slot", False), ("share-buttons", False), ("related posts", False), ("cookie-notice", False), ("comments-section", False),
])
def test_names_inside_an_article_count_as_a_whole(name, stays):
    html = f"<body><article><h1>T</h1><section class='{name}'><p>Own text</p></section><p>End</p></article></body>"
    assert alone(html) == ("T Own text End" if stays else "T End")


def whole_of(pages):
    whole = Wrapper.of(pages[0])
    for html in pages[1:]:
        whole = whole.merge(Wrapper.of(html))
    return Wrapper.load(whole.dump())


def test_texts_of_few_pages_stay():
    extras = ["<blockquote>Quote</blockquote>", "<h2>Part</h2>", "<pre>code</pre>", "<table><tr><td>cell</table>", "<ul><li>one</ul>", "<p>a <b>bold</b></p>"]
    texts = ["Quote", "Part", "code", "cell", "one", "a bold"]
    for extra, text in zip(extras, texts, strict=True):
        pages = [f"<article><h1>T {k}</h1>{extra if k == 4 else ''}<div>Body {k}</div></article>" for k in range(8)]
        assert main_text(pages[4], *whole_of(pages).facts()) == f"T 4 {text} Body 4"


def test_copies_of_a_page_do_not_agree_with_each_other():
    pages = [f"<article><h1>T {k}</h1>{'<pre>code</pre>' if k == 4 else ''}<p>Body {k}</p></article>" for k in range(8)]
    copies = whole_of([pages[4]] * 6)
    assert copies.facts() == (set(), None)
    assert main_text(pages[4], *whole_of(pages).merge(copies).facts()) == "T 4 code Body 4"
    often = [f"<article><h1>T {k}</h1>{'<pre>Advice</pre>' if k < 5 else ''}<p>Body {k}</p></article>" for k in range(8)]
    assert main_text(often[4], *whole_of(often).facts()) == "T 4 Advice Body 4"


def wide(k, parts):
    return f"<html><body><div class='top'>Our shop</div>{parts}<div class='m'><h2>Title {k}</h2><p>Text {k} runs on.</p></div><div class='low'>Call us</div></body></html>"


def test_wide_lists_keep_the_wrapper_of_a_host():
    names = "abcdefghij"
    # One page with a long list, and pages that each bring an element of a class of their own.
    pages = [wide(k, f"<section class='tag-{names[k // 10]}{names[k % 10]}'>Own {k}</section>") for k in range(100)]
    pages.append(wide(100, "".join(f"<section class='x{a}{b}{c}'>New</section>" for a in names for b in names for c in names[:5])))
    fixed, inner = whole_of(pages).facts()
    assert inner[-1] == "div.m" and {text for _, text in fixed} >= {"Our shop", "Call us"}
    assert "Call us" not in main_text(pages[7], fixed, ("html", "body")) and "Own 7" in main_text(pages[7], fixed, ("html", "body"))


@pytest.mark.parametrize("cells", [1, 30, 1 << 28])
def test_common_is_a_longest_subsequence(cells, monkeypatch):
    monkeypatch.setattr(wrappers, "CELLS", cells)
    chance = random.Random(cells)
    for _ in range(200):
        one, two = (chance.choices("abcd", k=chance.randint(0, 25)) for _ in range(2))
        best = [[0] * (len(two) + 1) for _ in range(len(one) + 1)]
        for i, a in enumerate(one):
            for j, b in enumerate(two):
                best[i + 1][j + 1] = best[i][j] + 1 if a == b else max(best[i][j + 1], best[i + 1][j])
        found = wrappers.common(one, two)
        assert len(found) == best[-1][-1] and all(one[i] == two[j] for i, j in found)
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(found, found[1:]))


def test_wrapper_comes_before_tags():
    teasers = [f"<body><div id='content'><h2>Story {k}</h2><p>Body {k} is told here at length.</p></div><article class='teaser'>Next {k}</article></body>" for k in range(8)]
    assert main_text(teasers[3], *whole_of(teasers).facts()) == "Story 3 Body 3 is told here at length."
    # Without a wrapper the tags decide.
    assert alone(teasers[3]) == "Next 3"


def test_story_in_several_articles_stays_whole():
    pages = ["<body><h1>Site</h1>" + "".join(f"<article><h2>Part {i}</h2><p>Text {k} {i} {'long ' * i}</p></article>" for i in range(2 + k % 3)) + "</body>" for k in range(8)]
    found = main_text(pages[3], *whole_of(pages).facts())
    assert found == "Part 0 Text 3 0 Part 1 Text 3 1 long"


def test_article_around_the_region_is_kept_whole():
    pages = [f"<body><main><article><h1>Head {k}</h1><div class='b'><p>{k} {'word ' * 40}</p></div></article><ul><li>More {k}</li></ul></main></body>" for k in range(8)]
    assert main_text(pages[3], *whole_of(pages).facts()) == "Head 3 3 " + ("word " * 40).strip()
    mains = [page.replace("article>", "section>") for page in pages]
    assert main_text(mains[3], *whole_of(mains).facts()) == "Head 3 3 " + ("word " * 40).strip() + " More 3"


def test_order_of_merging_does_not_matter_for_facts():
    pages = [Wrapper.of(page(k, "<h3>extra</h3>" if k % 2 else "", k)) for k in range(1, 9)]
    left, right = pages[0], pages[4]
    for k in (1, 2, 3):
        left, right = left.merge(pages[k]), right.merge(pages[4 + k])
    forward, back = left.merge(right).facts(), right.merge(left).facts()
    assert forward == back


def test_table_with_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(wrappers, "FAN", 2)
    rows = [(k, f"http://a.example/{k}?q", page(k), "x", "y") for k in range(40)]
    rows += [(None, None, None, "x", "y"), (50, "no url", "<p>x", "x", "y"), (51, "https://U@A.Example:80/p", "", "x", "y"), (3, "http://a.example/3?q", page(3), "x", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, wrapper string").repartition(7)
    found = extract_text(pages).collect()
    assert len(found) == len(rows)
    texts = {r["page_id"]: r["text"] for r in found}
    assert texts[None] == "" and texts[50] == "x" and texts[51] == ""
    assert texts[3].startswith("Title 3 Share this page Text 3") and "Call us" not in texts[3]
    made = {r["host"]: r["pages"] for r in infer_wrappers(pages).collect()}
    assert made["a.example"] >= 40 and len(made) == 2
    assert extract_text(pages.limit(0)).collect() == []


def plain(html):
    inner = re.search(r"<article>(.*?)</article>", html, re.S).group(1)
    blocks = [" ".join(entities.unescape(re.sub(r"</?b>", "", part)).split()) for part in re.split(r"</?(?:p|h1|br)>", inner)]
    return " ".join(block for block in blocks if block)


def test_generated_pages(spark):
    rows = duckdb.sql("SELECT page_id, html FROM '/root/testdata/sf0.1/pages.parquet'").fetchall()
    found = extract_text(spark.read.parquet("/root/testdata/sf0.1/pages.parquet")).collect()
    assert {r["page_id"]: r["text"] for r in found} == {key: plain(html) for key, html in rows}
