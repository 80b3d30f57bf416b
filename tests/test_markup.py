"""Element table and selectors, without Spark."""

import time

import pytest

from cardmill.operators.markup import Markup, Selector


def tags(html, selector):
    page = Markup(html)
    return [page.tag[n] for n in Selector(selector).select(page)]


def texts(html, selector):
    page = Markup(html)
    return [page.text(n) for n in Selector(selector).select(page)]


def test_text_joins_pieces_and_leaves_out_scripts_styles_comments():
    html = "<div> a <b>b&nbsp; c</b><!-- no --><script>var t='</p>';</script><style>p{}</style> &amp;d<br>e</div>"
    assert texts(html, "div") == ["a b c &d e"]
    assert texts(html, "script") == ["var t='</p>';"]


def test_template_and_ruby_text_belong_to_their_own_element():
    assert texts("<p>x<template><i>y</i></template><ruby>z<rt>w</rt></ruby></p>", "p, rt") == ["x z", "w"]


def test_block_start_closes_open_paragraph():
    assert texts("<p>one<p>two<div>three</div>four", "p") == ["one", "two"]
    assert texts("<p><table><tr><td><p>in</table>out", "td") == ["in"]


@pytest.mark.parametrize(
    ("html", "selector", "expected"),
    [
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "li", ["a", "b c", "c", "d"]),
        ("<dl><dt>a<dd>b<dt>c</dl>", "dt, dd", ["a", "b", "c"]),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "td", ["1", "2", "3"]),
        ("<select><option>a<option>b</select>", "option", ["a", "b"]),
        ("<head><title>t</title><body><p>x", "body", ["x"]),
    ],
)
def test_siblings_close_each_other(html, selector, expected):
    assert texts(html, selector) == expected


def test_unmatched_end_tags_and_open_tags():
    assert texts("<div>a</b></i>b<span>c", "div") == ["a b c"]
    assert texts("<article><p><b>x<br></article><footer>y</footer>", "article") == ["x"]


def test_attributes():
    page = Markup("""<a HREF=/x/ title='1 "2"' data-x="a&amp;b" disabled class=" b  a " class="z">t</a>""")
    assert page.attrs(0) == {
        "href": "/x/", "title": '1 "2"', "data-x": "a&b", "disabled": "", "class": " b  a ",
    }
    assert page.value(0, "class") == "b a"
    assert page.value(0, "title") == '1 "2"'
    assert page.value(0, "missing") == ""


def test_references():
    page = Markup('<a href="/c?a=1&section=2&amp;copy=3&#47;x&#x2f;y&unknown;">&lt;&copy;&section;&amp</a>')
    assert page.value(0, "href") == "/c?a=1&section=2&copy=3/x/y&unknown;"
    assert page.text(0) == "<©§ion;&"


def test_quote_without_end_loses_its_tag_only():
    assert texts('<p title="x>one</p><p>two</p>', "p") == ["one", "two"]


def test_cut_off_page():
    assert texts("<p>one</p><p>two <a hre", "p") == ["one", "two"]
    assert texts("<p>one<!-- <p>two", "p") == ["one"]
    assert texts("<p>one<!-- two", "p") == ["one"]
    assert texts("<p>one<!-->two<!--->three<!-- > -->four<!---->five", "p") == ["one two three four five"]
    assert texts("<p>one<!doctype x>two", "p") == ["one two"]
    assert texts("<p>1 < 2 & 3", "p") == ["1 < 2 & 3"]


def test_empty_element_values():
    page = Markup('<meta content=" c "><img src="s" alt="a"><img src="" alt="a"><input alt="x"><br>')
    assert [page.value(n, None) for n in range(5)] == ["c", "s", "a", "x", ""]


NAV = '<nav id="n"><a class="x y" rel="next" href="/1">1</a><b></b><a lang="en-US">2</a><a>3</a></nav><a>4</a>'


@pytest.mark.parametrize(
    ("selector", "expected"),
    [
        ("*", ["", "1", "", "2", "3", "4"]),
        ("#n a", ["1", "2", "3"]),
        ("nav > a.x.y", ["1"]),
        ("a[href]", ["1"]),
        ("a[rel=next], a[lang|=en]", ["1", "2"]),
        ("a[class~=y]", ["1"]),
        ("a[href^='/'], [href$=\"1\"]", ["1"]),
        ("a[lang*=US]", ["2"]),
        ("b + a", ["2"]),
        ("b ~ a", ["2", "3"]),
        ("nav a:first-child", ["1"]),
        ("a:last-child", ["3", "4"]),
        ("nav > :nth-child(2n+1)", ["1", "2"]),
        ("nav > *:nth-child(even)", ["", "3"]),
        ("nav > *:nth-child(-n+2)", ["1", ""]),
        ("nav > *:nth-child(3)", ["2"]),
        ("a:not(.x):not([lang])", ["3", "4"]),
        ("nav:not(#n) a", []),
    ],
)
def test_selectors(selector, expected):
    found = texts(NAV, selector)
    assert (found[1:] if selector == "*" else found) == (expected[1:] if selector == "*" else expected)


@pytest.mark.parametrize("selector", ["", "a >", "a::before", "a:hover", "a,", "a[b", ":nth-child()", ":not(a b)"])
def test_unsupported_selectors_are_refused(selector):
    with pytest.raises(ValueError):
        Selector(selector)


def test_first_takes_document_order_over_a_list():
    page = Markup("<i>1</i><b>2</b>")
    assert page.tag[Selector("b, i").first(page)] == "i"


def test_deep_nesting():
    page = Markup("<div>" * 5000 + "x")
    assert len(Selector("div div").select(page)) == 4999
    assert page.text(0) == "x"


@pytest.mark.parametrize(
    "piece",
    ["<div>", "<li>x", "</b>", "<a b='", "<a ", "<a href=", '<a x="', "<a b='>'", "<!--", "<!-- >", "<script>", "</script ",
     "<script></script ", "<", "<table><tr><td>", "<p><button>", "&", "<a\t\t\t"],
)
@pytest.mark.parametrize("tail", ["", ">", "-->x"])
def test_hostile_pages_take_linear_time(piece, tail):
    started = time.process_time()
    Markup(piece * 20_000 + tail)
    assert time.process_time() - started < 1
