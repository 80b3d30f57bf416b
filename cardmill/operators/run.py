"""Crawls that read only the pages they visit, each by the rules of its own spec.

A run goes in rounds. Every crawl asks for its next page; if its last steps went from one
page number to the next, it asks for the following numbers as well, twice as many in
each round. Robots rules are asked before the store, answers are classified with the
crawl's own settings, and what is left is parsed, all in one stage: the rule set is a
column, so pages of any number of specs share a stage. Then each crawl goes through the
pages of the round, as far as each leads to the next one (``blocks.follow``). Pages parsed
are at most twice the pages visited, plus one for each crawl; rounds grow with the
logarithm of a walk along page numbers, and by one for each other step.

Where a crawl has been is a table of ``(crawl_id, url)`` rows. It does not travel with the
crawl: the links of a round are sent to it, and those that it has come back.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.urls import origin
from ..functions.values import TRANSFORM, WS
from ..session import materialise, new_dir
from ..sources.page_store import PageStore
from . import extract, markup, rules
from .blocks import AHEAD, asked_pages, follow
from .crawl import MISSING
from .extract import EMPTY, PLACE, PageReader
from .gate import RETRY_STATUSES, content_type
from .joins import fits_broadcast, lookup
from .lint import spec_crawls, spec_fields, spec_lint
from .markup import Markup
from .robots import agent_rules, is_allowed, robots_sites
from .rules import FieldRule, PageRules, PagerRules

for module in (markup, rules, extract, sys.modules[__name__]):
    cloudpickle.register_pickle_by_value(module)

#: Pages that are dealt out to all cores, as their scan may come in one split.
FEW_PAGES = 10_000
#: Rule sets that a task keeps compiled, and pages of an output batch.
COMPILED, OUTPUT_ROWS = 1000, 256

RULES = T.StructType(
    [
        T.StructField("container", T.StringType()),
        T.StructField("next_selector", T.StringType()),
        T.StructField("link_selector", T.StringType()),
        T.StructField("fields", T.ArrayType(T.MapType(T.StringType(), T.StringType()))),
    ]
)
PARSED = T.StructType(
    [
        T.StructField("cards", T.ArrayType(T.ArrayType(T.StringType()))),
        T.StructField("next_url", T.StringType()),
        T.StructField("pager_urls", T.ArrayType(T.StringType())),
        T.StructField("parse_error", T.StringType()),
    ]
)
#: What the stage hands on beside the page.
KEPT = ["crawl_id", "url", "failed", "requests", "mode", "container", "names", "transforms", "required"]


def spec_runs(specs: DataFrame) -> DataFrame:
    """``spec_id, spec_json`` → one row per spec without problems: the settings of its run and its rule set.

    ``rules`` is the rule set as one text, ``names``, ``transforms`` and ``required`` have a place for each
    field. Of specs that share an id none is run. The result is a written table.
    """
    specs = specs.select("spec_id", "spec_json")
    several = specs.groupBy("spec_id").count().filter("count > 1 or spec_id is null").select("spec_id")
    broken = materialise(spec_lint(specs).select("spec_id").unionByName(several).distinct(), "broken")
    good = materialise(specs.filter("spec_id is not null").join(broken, "spec_id", "left_anti"), "specs")
    field = F.struct("field_no", "name", "selector", "attribute", "transform", "required", "collect_all", "join_with")
    fields = spec_fields(good).groupBy(F.col("spec_id").alias("crawl_id")).agg(F.array_sort(F.collect_list(field)).alias("fields"))
    crawls = spec_crawls(good).join(fields, "crawl_id")
    listed = F.transform(
        "fields",
        lambda f: F.struct(f["selector"], f["attribute"], f["transform"], f["collect_all"].alias("all"), f["join_with"]),
    )
    rule_set = F.to_json(F.struct("container", "next_selector", "link_selector", listed.alias("fields")))
    parts = [F.col(f"fields.{name}").alias(alias) for name, alias in (("name", "names"), ("transform", "transforms"), ("required", "required"))]
    return materialise(crawls.withColumn("rules", rule_set).select("*", *parts).drop("fields"), "runs")


def fixed_runs(crawls: DataFrame, rules: PageRules, pager: PagerRules | None = None) -> DataFrame:
    """Seeds (``read_crawls``) that all go by one rule set, with the default settings of a run."""
    pager = pager or PagerRules()
    rule_set = {
        "container": rules.container, "next_selector": pager.next_selector, "link_selector": pager.link_selector,
        "fields": [
            {"selector": f.selector, "attribute": f.attribute, "transform": f.transform, "all": f.collect_all, "join_with": f.join_with}
            for f in rules.fields
        ],
    }
    spec = crawls.sparkSession.createDataFrame([(0, json.dumps({"start_url": "https://x", "item": {}}))], "spec_id int, spec_json string")
    defaults = spec_crawls(spec).select("retries", "content_types", "user_agent").first()
    flags = F.array(*(F.lit(f.required) for f in rules.fields))
    return materialise(
        crawls.select(
            "crawl_id", "start_url", "mode", "url_template", "start_page", "max_pages", "stop_on_error",
            F.lit(defaults["retries"]).alias("retries"), F.array(*map(F.lit, defaults["content_types"])).alias("content_types"),
            F.lit(defaults["user_agent"]).alias("user_agent"), F.lit(True).alias("respect_robots"),
            F.lit(json.dumps(rule_set)).alias("rules"), F.array(*map(F.lit, rules.names)).alias("names"),
            F.array(*(F.lit(f.transform) for f in rules.fields)).alias("transforms"), flags.alias("required"),
        ),
        "runs",
    )


class _Readers:
    """Compiled rule sets by their text; one that cannot be compiled is an error of its pages."""

    def __init__(self) -> None:
        self.known: dict[str, PageReader | str] = {}

    def get(self, text: str) -> PageReader | str:
        if text not in self.known:
            if len(self.known) >= COMPILED:
                self.known.clear()
            own = json.loads(text)
            fields = tuple(
                FieldRule(str(k), f["selector"], f.get("attribute"), f["transform"], False, f["all"], f["join_with"])
                for k, f in enumerate(own["fields"])
            )
            try:
                self.known[text] = PageReader(
                    PageRules(own["container"], fields), PagerRules(own.get("next_selector"), own.get("link_selector"))
                )
            except ValueError as problem:
                self.known[text] = str(problem)
        return self.known[text]


def _stage(keep: list[str]):
    """Rows with ``url, html, rules`` → the columns to keep, raw values of each card, links and what is wrong."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers = _Readers()
        kinds = [pa.list_(pa.list_(pa.string())), pa.string(), pa.list_(pa.string()), pa.string()]
        for whole in batches:
            for start in range(0, whole.num_rows, OUTPUT_ROWS):
                batch = whole.slice(start, OUTPUT_ROWS)
                rows = [_page(readers, *row) for row in zip(*(batch.column(name).to_pylist() for name in ("url", "html", "rules")), strict=True)]
                columns = [pa.array([row[k] for row in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*(batch.column(name) for name in keep), *columns], [*keep, *PARSED.names])

    return run


def _page(readers: _Readers, url: str, html: str | None, rule_set: str) -> tuple[list, str | None, list[str], str | None]:
    if html is None:
        return [], None, [], None
    reader = readers.get(rule_set)
    if isinstance(reader, str):
        return [], None, [], reader
    page = Markup(html)
    try:
        cards, problem = reader.cards(page, url), None
    except ValueError as error:
        cards, problem = [], str(error)
    return cards, reader.next_url(page, url), reader.pager_urls(page, url), problem


def _value(raw: Column, transform: Column) -> Column:
    """A raw value after the transform of its field, named in a column."""
    value = raw
    for name, clean in TRANSFORM.items():
        value = F.when(transform == name, clean(raw)).otherwise(value)
    return value


@dataclass(frozen=True)
class Run:
    """Written tables of a run: ``visits`` (``crawl_id, n, round, url``) and ``read``, one row per page asked for.

    ``read`` has a row for each ``(crawl_id, round, url)``; ``parsed`` says if its page was parsed.
    """

    crawls: DataFrame
    visits: DataFrame
    read: DataFrame

    def visited(self) -> DataFrame:
        """One row per visit, as ``crawl.visited_pages`` has it; a card's one field is ``record``.

        ``record`` is a JSON object of the card's fields in their order, empty if all of them are.
        """
        joined = self.visits.join(self.read.drop("links"), ["crawl_id", "round", "url"])
        settings = self.crawls.select("crawl_id", "mode", "max_pages", "stop_on_error")
        return joined.drop("round", "parsed").join(settings, "crawl_id")


def run_crawls(crawls: DataFrame, store: PageStore, robots: DataFrame | None = None, ahead: int = AHEAD) -> Run:
    """Walk all ``crawls`` (``spec_runs``, ``fixed_runs``) over a store of fetched pages.

    ``robots`` has ``origin, robots_status, body`` rows; without it every page may be read. With
    ``ahead`` 1 only pages that are visited are parsed. A crawl of no pages has no visits.
    """
    spark = crawls.sparkSession
    sites = None if robots is None else robots_sites(robots)
    steps_dir, read_dir = new_dir(spark, "steps"), new_dir(spark, "read")
    state = crawls.filter("max_pages >= 1").select(
        "crawl_id", F.col("start_url").alias("url"), F.lit(0).cast("long").alias("n"), F.lit(min(2, ahead)).alias("guess")
    )
    rounds = T.StructField("round", T.IntegerType())
    # One round at least, of no pages if there are no crawls, so that both tables exist.
    number, visits = 0, None
    while number == 0 or not state.isEmpty():
        block = _facts(_answers(_asked(state, crawls), crawls, store, sites))
        schema = block.schema
        block.write.parquet(f"{read_dir}/round={number}")
        block = spark.read.schema(schema).parquet(f"{read_dir}/round={number}")
        made, state = follow(state, block, visits, crawls, ahead)
        made.write.parquet(f"{steps_dir}/round={number}")
        visits = spark.read.schema(T.StructType([*made.schema.fields, rounds])).parquet(steps_dir).select("crawl_id", "n", "round", "url")
        number += 1
    return Run(crawls, visits, spark.read.schema(T.StructType([*schema.fields, rounds])).parquet(read_dir))


def _asked(state: DataFrame, crawls: DataFrame) -> DataFrame:
    """``asked_pages`` with the settings of their crawls."""
    asked = asked_pages(state, crawls).drop("mode", "k")
    settings = ["retries", "content_types", "user_agent", "respect_robots", "rules", "mode", "names", "transforms", "required"]
    rows = state.agg(F.coalesce(F.sum("guess"), F.lit(0))).first()[0]
    return lookup(asked, crawls.select("crawl_id", *settings), "crawl_id", how="inner", rows=rows)


def _answers(asked: DataFrame, crawls: DataFrame, store: PageStore, sites: DataFrame | None) -> DataFrame:
    """``asked`` with ``failed``, ``requests`` and ``html``: what the store answers by each crawl's own settings."""
    denied = F.lit(False)
    if sites is not None:
        asked = asked.withColumn("__origin", origin(F.col("url")))
        # An origin may own most of the pages; its rules are a row, and few origins have many.
        small = F.broadcast(sites) if fits_broadcast(sites) else sites
        asked = asked.join(small.withColumnRenamed("origin", "__origin"), "__origin", "left")
        # ``is_allowed`` looks at the column ``rules``.
        verdict = asked.select("*", F.col("rules").alias("rule_set")).withColumn("rules", agent_rules(F.col("user_agent")))
        denied = F.coalesce(F.col("respect_robots"), F.lit(True)) & ~is_allowed(F.col("url"))
        asked = verdict.withColumn("denied", denied).drop("rules").withColumnRenamed("rule_set", "rules")
    else:
        asked = asked.withColumn("denied", denied)
    asked = asked.drop("__origin", "closed", "groups", "user_agent", "respect_robots")
    asked = materialise(asked, "asked")
    wanted = asked.filter("not denied").select("url")
    log, few = store.attempts(wanted), wanted.count() <= FEW_PAGES
    spark = asked.sparkSession
    tried = asked.filter("not denied").select("crawl_id", "url", "retries", "content_types").join(log, "url")
    kind = content_type(F.col("content_type"))
    fits = (kind == "") | F.exists("content_types", lambda prefix: F.startswith(kind, F.lower(prefix)))
    blank = ~F.coalesce("body", F.lit("")).rlike(f"[^{WS}]")
    problem = (
        F.when(F.col("status").isNull(), F.coalesce("net_error", F.lit("network error")))
        .when(F.col("status") != 200, F.concat(F.lit("HTTP "), F.col("status").cast("string")))
        .when(~fits, F.concat(F.lit("unexpected Content-Type: "), kind))
        .when(blank, F.lit(EMPTY))
    )
    again = F.col("problem").isNotNull() & (F.col("status").isNull() | F.col("status").isin(*RETRY_STATUSES))
    # Ranks are limited before the shuffle too: a crawl tries an URL a few times, however long its log is.
    place = F.row_number().over(Window.partitionBy("crawl_id", "url").orderBy("attempt"))
    tried = tried.withColumn("problem", problem).withColumn("place", place).filter(F.col("place") <= F.col("retries") + 1)
    row = F.struct("place", "problem", F.when(F.col("problem").isNull(), F.col("body")).alias("html"))
    end = F.coalesce(F.min_by(row, F.when(~again, F.col("place"))), F.max_by(row, "place"))
    ended = tried.groupBy("crawl_id", "url").agg(end.alias("end"))
    found = asked.join(ended, ["crawl_id", "url"], "left")
    error = F.when(F.col("denied"), "denied by robots.txt").when(F.col("end").isNull(), MISSING).otherwise(F.col("end.problem"))
    requests = F.when(F.col("denied"), 0).otherwise(F.coalesce("end.place", F.lit(1))).cast("long")
    found = found.select(*KEPT[:2], *KEPT[4:5], *KEPT[6:], "rules", F.concat("url", F.lit(": "), error).alias("failed"), requests.alias("requests"), F.col("end.html").alias("html"))
    return found.repartition(spark.sparkContext.defaultParallelism) if few else found


def _facts(answers: DataFrame) -> DataFrame:
    """What each page holds for the crawl that asked for it: counters, error, links and kept cards."""
    narrow = answers.withColumn("container", F.get_json_object("rules", "$.container")).select(*KEPT, "rules", "html")
    schema = T.StructType([*narrow.select(*KEPT).schema.fields, *PARSED.fields])
    joined = narrow.mapInArrow(_stage(KEPT), schema)

    def card(raw: Column, k: Column) -> Column:
        values = F.transform(raw, lambda v, i: _value(v, F.get(F.col("transforms"), i)))
        return F.struct((k + 1).alias(PLACE), values.alias("values"))

    joined = joined.withColumn("kept_cards", F.transform("cards", card))
    whole = F.filter("kept_cards", lambda c: F.forall(F.zip_with("required", c["values"], lambda needed, v: ~needed | (v != "")), lambda ok: ok))
    joined = joined.withColumn("kept_cards", whole)
    found, kept = F.size("cards").cast("long"), F.size("kept_cards").cast("long")
    empty = F.aggregate("kept_cards", F.lit(0).cast("long"), lambda n, c: n + F.size(F.filter(c["values"], lambda v: v == "")))

    def record(c: Column) -> Column:
        filled = F.exists(c["values"], lambda v: v != "")
        text = F.when(filled, F.to_json(F.map_from_arrays("names", c["values"]))).otherwise(F.lit(""))
        return F.struct(c[PLACE].alias(PLACE), text.alias("record"))

    links = F.when(F.col("mode") == "next", F.filter(F.array("next_url"), lambda link: link.isNotNull())).when(
        F.col("mode") == "links", F.col("pager_urls")
    )
    no_card = F.when(found == 0, F.concat(F.lit("no element matches "), F.col("container")))
    ok = F.col("failed").isNull()
    return joined.select(
        "crawl_id", "url", ok.alias("ok"), F.coalesce("failed", "parse_error", no_card).alias("error"), "requests",
        found.alias("found"), kept.alias("kept"), (found - kept).alias("skipped"), empty.alias("empty_fields"),
        F.coalesce(links, F.array().cast("array<string>")).alias("links"),
        F.when(ok, F.transform("kept_cards", record)).alias("kept_cards"), ok.alias("parsed"),
    )


def run_records(run: Run) -> DataFrame:
    """``crawl_id, n, url, card_no, record``: every kept card, its fields as a JSON object."""
    cards = run.visited().select("crawl_id", "n", "url", F.explode("kept_cards").alias("card"))
    return cards.select("crawl_id", "n", "url", F.col("card")[PLACE].alias("card_no"), "card.record")


def run_output(run: Run, existing: DataFrame | None = None) -> DataFrame:
    """``output_path, crawl_id, record``: the rows that each spec's output gets.

    Blank records go; a spec that asks for it repeats none, and if it appends as well, none that
    ``existing`` (``output_path, record``) has.
    """
    settings = run.crawls.select("crawl_id", "output_path", "deduplicate", "append")
    rows = lookup(run_records(run).filter("record <> ''").select("crawl_id", "record"), settings, "crawl_id", how="inner", rows=0)
    counted = rows.groupBy("output_path", "crawl_id", "record", "deduplicate", "append").agg(F.count("*").alias("copies"))
    if existing is not None:
        known = existing.select("output_path", "record").distinct().withColumn("known", F.lit(True))
        counted = counted.join(known, ["output_path", "record"], "left")
        counted = counted.filter("not (deduplicate and append and known is not null)")
    copies = F.when(F.col("deduplicate"), F.lit(1).cast("long")).otherwise(F.col("copies"))
    return counted.select("output_path", "crawl_id", "record", F.explode(F.sequence(F.lit(1).cast("long"), copies)).alias("copy")).drop("copy")


def write_output(rows: DataFrame, folder: str) -> None:
    """Add ``run_output`` to a folder of JSON lines, a part of it for each output path."""
    rows.write.partitionBy("output_path").mode("append").json(folder)


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """``output_path, crawl_id, record`` of a folder that ``write_output`` wrote."""
    return spark.read.schema("crawl_id string, record string, output_path string").json(folder)
