"""Cards out of pages: one Arrow stage, then native columns.

The stage parses every page once and returns its raw cards, its next link and
its pager links; HTML itself goes into the stage and does not come out. All of
this is narrow: one page row in, one page row out, no shuffle.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import add, and_
from urllib.parse import urljoin

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import TRANSFORM
from . import markup, rules
from .markup import Markup, Selector
from .rules import PageRules, PagerRules

# Executors need no copy of this package: the stage travels with its plan.
for module in (markup, rules, sys.modules[__name__]):
    cloudpickle.register_pickle_by_value(module)

OUTPUT_ROWS = 256
# Place of a card on its page, within the struct of its fields.
PLACE = "__card_no"
# What is wrong with a page without text; walks take it for a failed visit.
EMPTY = "empty response"

LIST_OF_TEXT = T.ArrayType(T.StringType(), False)


def parse_pages(
    pages: DataFrame,
    rules: PageRules,
    pager: PagerRules | None = None,
    keep: Sequence[str] = ("page_id", "url"),
) -> DataFrame:
    """One row per page: ``keep`` columns, ``cards``, links and ``parse_error``.

    ``cards`` is an array of structs of raw strings in document order; values of
    ``url`` fields are already absolute.
    """
    # Selectors are compiled here too, so that a bad one fails at plan time.
    for text in [rules.container, *(f.selector for f in rules.fields)]:
        Selector(text)
    fields = pages.select(*keep).schema.fields + [T.StructField("cards", _raw_type(rules))]
    fields += [
        T.StructField("next_url", T.StringType()),
        T.StructField("pager_urls", LIST_OF_TEXT),
        T.StructField("parse_error", T.StringType()),
    ]
    narrow = pages.select(*keep, F.col("url").alias("__url"), F.col("html").alias("__html"))
    return narrow.mapInArrow(_stage(rules, pager or PagerRules(None), list(keep)), T.StructType(fields))


def _raw_type(rules: PageRules) -> T.ArrayType:
    fields = [T.StructField(PLACE, T.IntegerType(), False)]
    fields += [T.StructField(name, T.StringType(), False) for name in rules.names]
    return T.ArrayType(T.StructType(fields), False)


def _values(rules: PageRules, card: Column) -> list[Column]:
    return [TRANSFORM.get(f.transform, lambda c: c)(card[f.name]).alias(f.name) for f in rules.fields]


def _stage(rules: PageRules, pager: PagerRules, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = PageReader(rules, pager)
        for whole in batches:
            for start in range(0, whole.num_rows, OUTPUT_ROWS):
                yield reader.read(whole.slice(start, OUTPUT_ROWS), keep)

    return run


class PageReader:
    """Reads one Arrow batch of pages into one Arrow batch of raw cards."""

    def __init__(self, rules: PageRules, pager: PagerRules) -> None:
        self.container = Selector(rules.container)
        self.names = rules.names
        self.fields = [(Selector(f.selector), f) for f in rules.fields]
        self.next = Selector(pager.next_selector) if pager.next_selector else None
        self.links = Selector(pager.link_selector) if pager.link_selector else None

    def read(self, batch: pa.RecordBatch, keep: list[str]) -> pa.RecordBatch:
        offsets, numbers, errors, nexts, pagers = [0], [], [], [], []
        values: list[list[str]] = [[] for _ in self.fields]
        for url, html in zip(batch.column("__url").to_pylist(), batch.column("__html").to_pylist(), strict=True):
            page, url = Markup(html or ""), url or ""
            try:
                cards = self.cards(page, url)
                errors.append(None if html and not html.isspace() else EMPTY)
            except ValueError as problem:
                cards = []
                errors.append(str(problem))
            numbers.extend(range(1, len(cards) + 1))
            for card in cards:
                for column, value in zip(values, card, strict=True):
                    column.append(value)
            offsets.append(len(numbers))
            nexts.append(self.next_url(page, url))
            pagers.append(self.pager_urls(page, url))
        columns = [pa.array(numbers, pa.int32()), *(pa.array(v, pa.string()) for v in values)]
        cards = pa.StructArray.from_arrays(columns, [PLACE, *self.names])
        return pa.RecordBatch.from_arrays(
            [
                *(batch.column(name) for name in keep),
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), cards),
                pa.array(nexts, pa.string()),
                pa.array(pagers, pa.list_(pa.string())),
                pa.array(errors, pa.string()),
            ],
            [*keep, "cards", "next_url", "pager_urls", "parse_error"],
        )

    def cards(self, page: Markup, url: str) -> list[list[str]]:
        return [
            [self.field(page, url, card, selector, rule) for selector, rule in self.fields]
            for card in self.container.select(page)
        ]

    def field(self, page: Markup, url: str, card: int, selector: Selector, rule) -> str:
        low, high = card + 1, page.end[card]
        if rule.collect_all:
            found = (page.value(node, rule.attribute) for node in selector.select(page, low, high))
            value = rule.join_with.join(v for v in found if v)
        else:
            node = selector.first(page, low, high)
            value = "" if node is None else page.value(node, rule.attribute)
        if rule.transform == "url":
            value = value.strip()
            return urljoin(url, value) if value else ""
        return value

    def next_url(self, page: Markup, url: str) -> str | None:
        node = self.next.first(page) if self.next else None
        if node is None or "disabled" in page.classes(node):
            return None
        return _link(page, node, url)

    def pager_urls(self, page: Markup, url: str) -> list[str]:
        nodes = self.links.select(page) if self.links else []
        return [link for node in nodes if (link := _link(page, node, url)) is not None]


def _link(page: Markup, node: int, url: str) -> str | None:
    href = page.attrs(node).get("href", "").strip()
    if href in ("", "#"):
        return None
    try:
        return urljoin(url, href)
    except ValueError:  # not an address, so nothing to follow
        return None


def _is_complete(rules: PageRules, card: Column) -> Column:
    return reduce(and_, (card[name] != "" for name in rules.required), F.lit(True))


def origins(columns: dict[str, Column], fields: Sequence[str]) -> list[Column]:
    """Columns that say where a row comes from; one named like a field goes by ``source_`` and its name."""
    return [column.alias(f"source_{name}" if name in fields else name) for name, column in columns.items()]


def records(parsed: DataFrame, rules: PageRules, keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """One row per card: ``keep``, ``card_no`` and the declared fields.

    Cards with a required field empty after its transform are left out. A field may
    have any name; see ``origins`` for one that is also the name of another column.
    """
    cards = parsed.select(F.struct(*keep).alias("page"), F.explode("cards").alias("raw"))
    cards = cards.select("page", F.col("raw")[PLACE].alias("place"), F.struct(*_values(rules, F.col("raw"))).alias("card"))
    whole = cards.filter(_is_complete(rules, F.col("card")))
    page = {name: F.col("page")[name] for name in keep}
    return whole.select(*origins({**page, "card_no": F.col("place")}, rules.names), *(F.col("card")[name].alias(name) for name in rules.names))


def page_facts(
    parsed: DataFrame, rules: PageRules, strict: bool = False, keep: Sequence[str] = ("page_id", "url")
) -> DataFrame:
    """Counters, error and links of each page, with its kept cards.

    Counting inside the row's own array needs no grouping and keeps pages
    without cards. With ``strict`` a page that lost all its cards is an error.
    """

    def cleaned(card: Column) -> Column:
        return F.struct(card[PLACE].alias(PLACE), *_values(rules, card))

    def blanks(card: Column) -> Column:
        return reduce(add, (F.when(card[name] == "", 1).otherwise(0) for name in rules.names))

    kept_cards = F.filter(F.transform("cards", cleaned), lambda card: _is_complete(rules, card))
    found, kept = F.size("cards"), F.size("kept_cards")
    no_card = F.lit(f"no element matches {rules.container}")
    error = F.coalesce(F.col("parse_error"), F.when(found == 0, no_card))
    if strict:
        error = F.coalesce(error, F.when(kept == 0, F.lit("every card lacks a required field")))
    return parsed.withColumn("kept_cards", kept_cards).select(
        *keep,
        found.cast("long").alias("found"),
        kept.cast("long").alias("kept"),
        (found - kept).cast("long").alias("skipped"),
        F.aggregate("kept_cards", F.lit(0).cast("long"), lambda n, card: n + blanks(card)).alias("empty_fields"),
        error.alias("error"),
        "next_url",
        "pager_urls",
        "kept_cards",
    )
