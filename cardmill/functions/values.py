"""Text and number cleaning as native columns (text in, text out)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space (Java's \s knows ASCII only) and decimal digits.
WS = (
    r"\s\x0b\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
DIGIT = r"\p{Nd}"
# What Python's float strips; the separators U+001C-U+001F are white space, yet not to it.
NUMBER_WS = WS.replace(r"\x1c-\x1f", "")
NUMBER = rf"^[{NUMBER_WS}]*-?({DIGIT}+\.?{DIGIT}*|\.{DIGIT}+)[{NUMBER_WS}]*\z"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Name an intermediate, so that using it often does not copy its expression."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A[{WS}]+|[{WS}]+\z", "")


def text(c: Column) -> Column:
    """Every run of white space becomes one blank; none at the ends."""
    return F.trim(F.regexp_replace(c, f"[{WS}]+", " "))


def price(c: Column) -> Column:
    """Amount without currency and thousands marks, with a decimal point."""
    digits = strip(F.regexp_replace(c, rf"[^{DIGIT}{WS}.,'-]", ""))
    digits = F.regexp_replace(F.translate(digits, " '", ""), r"[.-]+\z", "")
    return bind(F.regexp_replace(digits, rf"\A[{WS}]+", ""), _decimal_point)


def _decimal_point(c: Column) -> Column:
    has_comma, has_point = F.contains(c, F.lit(",")), F.contains(c, F.lit("."))
    comma_is_last = c.rlike(r"(?s),[^.]*\z")
    thousands = c.rlike(r"(?s)\A.+,[^,]{3}\z")
    bare_tail = c.rlike(r"(?s)\A,[^,]*\z")
    return (
        F.when(~has_comma, c)
        .when(has_point & comma_is_last, F.translate(c, ",.", "."))
        .when(has_point | thousands, F.translate(c, ",", ""))
        .when(bare_tail, F.concat(F.lit("0"), F.translate(c, ",", ".")))
        .otherwise(F.regexp_replace(c, r",([^,]*)\z", ".$1"))
    )


def only_number(priced: Column) -> Column:
    return F.when(priced.rlike(NUMBER), priced).otherwise("")


def number(c: Column) -> Column:
    """The price, if it reads as one number."""
    return bind(price(c), only_number)


def whole(c: Column) -> Column:
    """The number's text before the decimal point."""
    return F.substring_index(number(c), ".", 1)


TRANSFORM: dict[str, Callable[[Column], Column]] = {
    "text": text,
    "strip": strip,
    "price": price,
    "float": number,
    "int": whole,
}
