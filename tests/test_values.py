import random
import sys
from urllib.parse import unquote as python_unquote

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cardmill.functions.urls import after_origin, bump_page, origin, unquote
from cardmill.functions.values import number, price, strip, text, whole

PRICES = [
    ("Kč 45 080", "45080", "45080", "45080"),
    ("7.031.044,08 lei", "7031044.08", "7031044.08", "7031044"),
    ("8 630,4", "8630.4", "8630.4", "8630"),
    ("£6,020", "6020", "6020", "6020"),
    ("0,3 zł", "0.3", "0.3", "0"),
    ("~71~", "71", "71", "71"),
    ("ask at the desk", "", "", ""),
    ("1,299,50", "1,299.50", "", ""),
    (",5", "0.5", "0.5", "0"),
    (",500", "0.500", "0.500", "0"),
    (",", "0.", "0.", "0"),
    (".5", ".5", ".5", ""),
    ("-.5", "-.5", "-.5", "-"),
    ("-5", "-5", "-5", "-5"),
    ("10-20", "10-20", "", ""),
    ("1.299.50", "1.299.50", "", ""),
    ("1e5", "15", "15", "15"),
    ("−7", "7", "7", "7"),
    ("$1,299.50", "1299.50", "1299.50", "1299"),
    ("1'299.50 CHF", "1299.50", "1299.50", "1299"),
    ("1,234,567", "1234567", "1234567", "1234567"),
    ("1 299 ₽", "1 299", "", ""),
    ("5 -", "5", "5", "5"),
    ("-", "", "", ""),
    ("", "", "", ""),
    ("١٢", "١٢", "١٢", "١٢"),
]


def test_price_vectors(spark):
    table = spark.createDataFrame([(row[0],) for row in PRICES], "raw string").coalesce(1)
    raw = F.col("raw")
    got = table.select("raw", price(raw), number(raw), whole(raw)).collect()
    assert [tuple(row) for row in got] == PRICES


def test_prices_written_in_many_ways(spark):
    rng = random.Random(7)
    cases = []
    for _ in range(4000):
        units, cents = rng.choice([rng.randrange(1000), rng.randrange(10**9)]), rng.randrange(100)
        mark, point = rng.choice([(" ", ","), (".", ","), (",", "."), ("'", "."), ("", ","), ("", ".")])
        grouped = f"{units:,}".replace(",", mark)
        before, after = rng.choice(["", "$", "от ", " \n", "€\t"]), rng.choice(["", " ₽", " руб.", " €", "--", ".-"])
        cases.append((f"{before}{grouped}{point}{cents:02d}{after}", f"{units}.{cents:02d}"))
    table = spark.createDataFrame(cases, "raw string, want string")
    assert table.filter(price(F.col("raw")) != F.col("want")).collect() == []
    assert table.filter(number(F.col("raw")) != F.col("want")).collect() == []
    assert table.filter(whole(F.col("raw")) != F.substring_index("want", ".", 1)).collect() == []


def test_white_space_is_unicode(spark):
    spaces = [chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace()]
    rng = random.Random(5)
    letters = [*"abя№,.'\"\\$", "​", "᠎", "﻿", "😀"]
    cases = [("".join(rng.choice(spaces if rng.random() < 0.5 else letters) for _ in range(12)),) for _ in range(3000)]
    table = spark.createDataFrame(cases, "raw string")
    for row in table.select("raw", text("raw").alias("t"), strip("raw").alias("s")).collect():
        assert row.t == " ".join(row.raw.split())
        assert row.s == row.raw.strip()


@pytest.mark.parametrize(
    ("url", "delta", "expected"),
    [
        ("http://a.test/list?p=19", 1, "http://a.test/list?p=20"),
        ("HTTPS://A.test/?q=z&offset=40&view=all#x", 20, "https://A.test/?q=z&offset=60&view=all#x"),
        ("https://a.test/?p=5&page=8", 3, "https://a.test/?p=8&page=11"),
        ("https://a.test/?offset=3", -5, "https://a.test/?offset=-2"),
        ("https://a.test/list/9", 1, None),
        ("https://a.test/?paged=4", 1, None),
        ("https://a.test/?p=" + "9" * 40, 1, "https://a.test/?p=1" + "0" * 40),
        ("https://a.test/?p=1" + "0" * 45, -1, "https://a.test/?p=" + "9" * 45),
        ("https://a.test/?p=7", 100_000, "https://a.test/?p=100007"),
        ("https://x.test/page=1?q=page=2#page=3", 1, None),
        ("https://x.test/c?P=009&pages=1&page=x#?page=2", 1, "https://x.test/c?P=10&pages=1&page=x#?page=2"),
        ("https://x.test/c?a=b?page=1", 1, "https://x.test/c?a=b?page=2"),
        ("https://x.test/c?page=99999999999999999999", 1, "https://x.test/c?page=100000000000000000000"),
    ],
)
def test_bump_page(spark, url, delta, expected):
    table = spark.createDataFrame([(url,)], "url string")
    assert table.select(bump_page(F.col("url"), delta)).first()[0] == expected


def test_url_parts(spark):
    rows = [("HTTP://A.test:80/b?c#d", "http://A.test:80", "/b?c#d"), ("https://a.test?x", "https://a.test", "?x")]
    table = spark.createDataFrame([(r[0],) for r in rows], "url string").coalesce(1)
    assert [tuple(r) for r in table.select("url", origin(F.col("url")), after_origin(F.col("url"))).collect()] == rows


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(st.sampled_from("%a2+Fé/ 0zЯ"), max_size=9), min_size=30, max_size=60))
def test_unquote(spark, values):
    table = spark.createDataFrame([(v,) for v in values], "v string")
    for row in table.select("v", unquote(F.col("v")).alias("u")).collect():
        if "�" not in python_unquote(row.v):
            assert row.u == python_unquote(row.v)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 10**60), min_size=20, max_size=40), st.integers(-(10**14), 10**14))
def test_page_numbers_of_any_length(spark, numbers, delta):
    table = spark.createDataFrame([(f"https://a.test/?p={n}",) for n in numbers], "url string").coalesce(1)
    assert [r[0] for r in table.select(bump_page(F.col("url"), delta)).collect()] == [f"https://a.test/?p={n + delta}" for n in numbers]


def plain_number(raw):
    """What a price reads as: itself if Python's float takes it, else nothing.

    Separators beside other than ASCII white space are left open: float takes them there only.
    """
    if not raw.isascii() and set(raw) & set("\x1c\x1f"):
        return None
    try:
        float(raw)
    except ValueError:
        return ""
    return raw


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(st.sampled_from("0129.-\x1f\x1c\x85\xa0 \n"), max_size=6), min_size=40, max_size=80))
def test_numbers_of_arbitrary_strings(spark, values):
    table = spark.createDataFrame([(v,) for v in values], "raw string").coalesce(1)
    for row in table.select(price("raw").alias("p"), number("raw").alias("n")).collect():
        want = plain_number(row.p)
        assert want is None or row.n == want, (row.p, row.n)
