"""Queries over a table of extraction specs, one per customer's site."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lint import spec_crawls, spec_fields, spec_lint
from ..sources.pages import read_crawls, seed_problems, spread
from .catalogue import read
from .registry import query

ROW = {"container": "li.row", "fields": [{"name": "label", "selector": "b", "required": True}]}
SPEC = {"start_url": "https://site#ID#.test/list", "item": ROW}


def _with(**more) -> dict:
    return {**SPEC, **more}


def _fields(*fields) -> dict:
    return _with(item={"container": "li.row", "fields": list(fields)})


WALK = {"mode": "template", "url_template": "https://site#ID#.test/list/{page}", "max_pages": 44}
# Documents and what is wrong with each, one check of the lint after the other; a customer gets the one of its number.
CASES: list[tuple[dict | list | str, list[tuple[str, str]]]] = [
    # The document and its address.
    ("a text", [("", "the document is not an object")]),
    (_with(start_url="site#ID#.test/list"), [("start_url", "must start with http:// or https://")]),
    ({"item": ROW, "start_url": ""}, [("start_url", "expected a text")]),
    ({"pagination": {}}, [("start_url", "missing"), ("item", "missing")]),
    # Settings of the run.
    (_with(output={"path": " ", "append": 1}), [("output.path", "expected a text"), ("output.append", "expected true or false")]),
    (_with(verify_ssl="on"), [("verify_ssl", "expected true or false")]),
    (_with(timeout=-0.5, retries=-7), [("timeout", "must be > 0"), ("retries", "must be >= 0")]),
    (_with(user_agents=[]), [("user_agents", "expected a list of texts")]),
    (_with(delay={"min": -3}), [("delay.min", "must be >= 0")]),
    (_with(delay={"max": 6, "min": 6.5}), [("delay.min", "is above delay.max")]),
    # Where the walk goes.
    (_with(pagination={"mode": "template", "url_template": "/list/2"}), [("pagination.url_template", "lacks {page}")]),
    (_with(pagination={"mode": "template"}), [("pagination.url_template", "needed for mode template")]),
    (_with(pagination={"mode": "links"}), [("pagination.link_selector", "needed for mode links")]),
    (_with(pagination={"next_selector": None}), [("pagination.next_selector", "needed for mode next")]),
    (_with(pagination={"mode": "spiral"}), [("pagination.mode", "unknown mode")]),
    (_with(pagination={"start_page": -2, "max_pages": "0"}), [
        ("pagination.start_page", "must be >= 1"), ("pagination.max_pages", "must be >= 1")]),
    # What is taken.
    (_with(item=None), [("item", "missing")]),
    (_with(item={"container": "\t", "fields": "b"}), [
        ("item.container", "expected a text"), ("item.fields", "expected a list of rules")]),
    (_fields(), [("item.fields", "expected a list of rules")]),
    (_fields({"selector": "i"}, {"name": "i", "selector": "u"}), [("item.fields", "repeated name: i")]),
    (_fields({"selector": "i", "transform": "upper"}), [("item.fields[0].transform", "unknown transform")]),
    (_fields(["i"], {"name": "x"}, {"selector": "~"}), [
        ("item.fields[0]", "expected an object"), ("item.fields[1].selector", "missing"),
        ("item.fields[2].name", "no name in the selector")]),
    (_fields({"selector": "i", "required": "yes"}), [("item.fields[0].required", "expected true or false")]),
    # Nothing wrong.
    (SPEC, []),
    (_with(pagination=WALK, timeout="8.5", retries=0, delay=0.1, user_agents="a reader"), []),
    (_fields({"selector": "td.sum em"}, {"selector": " b > .when ", "transform": "int", "required": True},
             {"name": "\tnotes ", "selector": "q", "all": True, "join_with": "; ", "attribute": "cite"}), []),
]

VALID = [k for k, (_, found) in enumerate(CASES) if not found]
PLAIN, TEMPLATE, THREE = VALID
FIELDS: dict[int, list[tuple[str, str, str | None, str, bool, bool, str]]] = {
    THREE: [
        ("sum_em", "td.sum em", None, "text", False, False, " "),
        ("b_when", "b > .when", None, "int", True, False, " "),
        ("notes", "q", "cite", "text", False, True, "; "),
    ],
}


def specs(spark, sf_dir: str) -> DataFrame:
    documents = F.array(*(F.lit(json.dumps(document)) for document, _ in CASES))
    document = F.element_at(documents, (F.col("c_custkey") % len(CASES) + 1).cast("int"))
    return spread(read(spark, sf_dir, "customer").select("c_custkey")).select(
        F.col("c_custkey").alias("spec_id"),
        F.replace(document, F.lit("#ID#"), F.col("c_custkey").cast("string")).alias("spec_json"),
    )


def _sql(value) -> str:
    if value is None:
        return "NULL::VARCHAR"
    return str(value).lower() if isinstance(value, bool | int) else "'" + value.replace("'", "''") + "'"


def _values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(_sql, row)) + ")" for row in rows) + ")"


PROBLEMS = _values([(k, path, problem) for k, (_, found) in enumerate(CASES) for path, problem in found])


@query(
    f"""SELECT c_custkey AS spec_id, path, problem FROM customer
    JOIN {PROBLEMS} v(k, path, problem) ON c_custkey % {len(CASES)} = k""",
    name="spec_lint",
)
def spec_problems(spark, sf_dir):
    return spec_lint(specs(spark, sf_dir))


@query(
    f"""SELECT c_custkey AS spec_id, field_no, name, selector, attribute, transform, required, collect_all, join_with
    FROM customer JOIN {
        _values(
            [
                (k, i, *field)
                for k in VALID
                for i, field in enumerate(FIELDS.get(k, [("label", "b", None, "text", True, False, " ")]))
            ]
        )
    }
    v(k, field_no, name, selector, attribute, transform, required, collect_all, join_with) ON c_custkey % {len(CASES)} = k""",
    name="spec_fields",
)
def spec_rules(spark, sf_dir):
    """The field rules of specs without problems."""
    table = specs(spark, sf_dir)
    broken = spec_lint(table).select("spec_id").distinct()
    return spec_fields(table.join(broken, "spec_id", "left_anti"))


@query(
    f"""SELECT c_custkey AS crawl_id, 'https://site' || c_custkey || '.test/list' AS start_url,
      CASE WHEN k = {TEMPLATE} THEN 'template' ELSE 'next' END AS mode,
      CASE WHEN k = {TEMPLATE} THEN 'https://site' || c_custkey || '.test/list/{{page}}' END AS url_template,
      CASE WHEN k = {TEMPLATE} THEN 44 ELSE 10 END::BIGINT AS max_pages
    FROM (SELECT *, c_custkey % {len(CASES)} AS k FROM customer) WHERE k IN ({", ".join(map(str, VALID))})""",
    name="spec_crawls",
)
def spec_seeds(spark, sf_dir):
    """The crawls of specs without problems."""
    table = specs(spark, sf_dir)
    broken = spec_lint(table).select("spec_id").distinct()
    crawls = spec_crawls(table.join(broken, "spec_id", "left_anti"))
    return crawls.select("crawl_id", "start_url", "mode", "url_template", "max_pages")


@query(
    """SELECT c_custkey AS crawl_id, CASE c_custkey % 5 WHEN 0 THEN 'unknown mode: Links' WHEN 1 THEN 'start_url is not an http(s) address'
      WHEN 2 THEN 'start_url is missing' WHEN 3 THEN 'max_pages must be at least 1' END AS problem
    FROM customer WHERE c_custkey % 5 <> 4
    UNION ALL SELECT c_custkey, 'walked from https://site' || c_custkey || '.test' FROM customer WHERE c_custkey % 5 = 4"""
)
def seed_report(spark, sf_dir):
    """Seeds of customers: four kinds that cannot be walked, with the reason, and the good ones."""
    kind, number = F.col("c_custkey") % 5, F.col("c_custkey").cast("string")
    url = F.concat(F.lit("\t https://site"), number, F.lit(".test "))
    seeds = read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("crawl_id"),
        F.when(kind == 1, F.concat(F.lit("site"), number)).when(kind == 2, F.lit(" \t")).otherwise(url).alias("start_url"),
        F.when(kind == 0, F.lit("Links")).alias("mode"),
        F.when(kind == 3, F.lit(0)).alias("max_pages"),
    )
    good = read_crawls(seeds).select("crawl_id", F.concat(F.lit("walked from "), "start_url").alias("problem"))
    return seed_problems(seeds).select("crawl_id", "problem").unionByName(good)
