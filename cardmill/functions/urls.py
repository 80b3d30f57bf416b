"""URL columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of query parameters that number pages.
PAGE_PARAMETER = r"(?is)\A([?&](?:page|p|offset)=)([0-9]+)(.*)\z"
# Digits that one step of adding takes: far below the limit of a long.
DIGITS = 15


def origin(url: Column) -> Column:
    """``scheme://host[:port]`` in the form robots rules are stored under."""
    scheme = F.lower(F.regexp_extract(url, r"\A([^:/?#]+)://", 1))
    return F.concat(scheme, F.lit("://"), F.regexp_extract(url, r"\A[^:/?#]+://([^/?#]*)", 1))


def after_origin(url: Column) -> Column:
    return F.regexp_replace(url, r"\A[^:/?#]+://[^/?#]*", "")


def unquote(c: Column) -> Column:
    """Percent decoding that leaves ``+`` and broken escapes alone."""
    safe = F.regexp_replace(F.replace(c, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.try_url_decode(safe)


def page_url(template: Column, number: Column) -> Column:
    return F.replace(template, F.lit("{page}"), number.cast("string"))


def add_whole(digits: Column, delta: int | Column) -> Column:
    """A whole number of any length, as text, plus ``delta``.

    A long number is added in groups of digits from the right, with a carry. It is
    larger than any ``delta``, so only a short one can become negative.
    """
    limit = 10**DIGITS
    if isinstance(delta, int):
        if abs(delta) >= limit:
            raise ValueError(f"delta must have at most {DIGITS} digits")
        delta = F.lit(delta)
    plain = F.regexp_replace(digits, r"\A0+(?=.)", "")
    groups = F.ceil(F.length(plain) / DIGITS).cast("int")
    padded = F.lpad(plain, groups * DIGITS, "0")

    def step(state: Column, k: Column) -> Column:
        value = F.substring(padded, (groups - 1 - k) * DIGITS + 1, F.lit(DIGITS)).cast("long") + state["carry"]
        text = F.concat(F.lpad(F.pmod(value, F.lit(limit)).cast("string"), DIGITS, "0"), state["text"])
        return F.struct(text.alias("text"), F.floor(value / limit).cast("long").alias("carry"))

    start = F.struct(F.lit("").alias("text"), delta.cast("long").alias("carry"))
    total = F.aggregate(F.sequence(F.lit(0), groups - 1), start, step, lambda s: F.concat(s["carry"].cast("string"), s["text"]))
    # Cut before the cast: both branches may be worked out for any number.
    short = (F.substring(plain, 1, DIGITS).cast("long") + delta).cast("string")
    return F.when(F.length(plain) <= DIGITS, short).otherwise(F.regexp_replace(total, r"\A0+(?=.)", ""))


def bump_page(url: Column, delta: int | Column = 1) -> Column:
    """Shift every page number of the query; null where the query has none.

    Numbers may have any length; they are written in ASCII digits. The scheme comes
    out in small letters.
    """
    query = F.regexp_extract(url, r"\A[^?#]*(\?[^#]*)", 1)
    parts = F.split(query, "(?=[?&])")

    def shift(part: Column) -> Column:
        number = add_whole(F.coalesce(F.nullif(F.regexp_extract(part, PAGE_PARAMETER, 2), F.lit("")), F.lit("0")), delta)
        head, tail = F.regexp_extract(part, PAGE_PARAMETER, 1), F.regexp_extract(part, PAGE_PARAMETER, 3)
        return F.when(part.rlike(PAGE_PARAMETER), F.concat(head, number, tail)).otherwise(part)

    scheme = F.lower(F.regexp_extract(url, r"\A[A-Za-z][A-Za-z0-9+.-]*:", 0))
    before = F.concat(scheme, F.regexp_extract(url, r"\A(?:[A-Za-z][A-Za-z0-9+.-]*:)?([^?#]*)", 1))
    fragment = F.regexp_extract(url, r"#.+\z", 0)
    bumped = F.concat(before, F.array_join(F.transform(parts, shift), ""), fragment)
    return F.when(F.exists(parts, lambda part: part.rlike(PAGE_PARAMETER)), bumped)
