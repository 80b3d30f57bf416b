import json

import pytest

from cardmill.operators.lint import spec_crawls, spec_fields, spec_lint
from cardmill.plans.spec_queries import CASES, FIELDS, PLAIN, THREE


def specs(spark, *documents):
    rows = [(i, d if isinstance(d, str) else json.dumps(d, ensure_ascii=False)) for i, d in enumerate(documents)]
    return spark.createDataFrame(rows, "spec_id int, spec_json string")


def problems(spark, *documents):
    found = {i: set() for i in range(len(documents))}
    for row in spec_lint(specs(spark, *documents)).collect():
        assert (row.path, row.problem) not in found[row.spec_id]
        found[row.spec_id].add((row.path, row.problem))
    return list(found.values())


def document(**more):
    """The least a spec needs, and what a test adds."""
    fields = [{"selector": "dd.worth", "name": "worth"}]
    return {"item": {"fields": fields, "container": "dl"}, "start_url": "http://coins.test/bids", **more}


def test_listed_cases(spark):
    assert problems(spark, *(d for d, _ in CASES)) == [set(found) for _, found in CASES]


GOOD = [
    document(delay=0), document(delay=True), document(delay=None), document(delay={"max": 1}), document(delay=""),
    document(timeout="1e1"), document(retries="0"), document(retries=2.9), document(retries=True), document(user_agents=None),
    document(user_agents=["a", "b"]), document(pagination=None), document(pagination={"mode": "none", "next_selector": None}),
    document(output=None), document(output={"append": None, "encoding": "utf-8"}), document(allowed_content_types=[]),
    document(start_url="  http://x "), document(unknown=[1]),
]
BAD = [
    (document(delay="x"), "delay"),
    (document(delay=[1]), "delay"),
    (document(delay=-1), "delay.min"),
    (document(delay={"min": None}), "delay.min"),
    (document(delay={"max": "soon"}), "delay.max"),
    (document(delay={"max": 0.5}), "delay.min"),
    (document(timeout=None), "timeout"),
    (document(timeout="soon"), "timeout"),
    (document(retries="1.5"), "retries"),
    (document(retry_backoff=-0.1), "retry_backoff"),
    (document(user_agents=""), "user_agents"),
    (document(user_agents=["a", " "]), "user_agents"),
    (document(user_agents=["a", 1]), "user_agents"),
    (document(user_agents={"a": 1}), "user_agents"),
    (document(pagination=[1]), "pagination"),
    (document(pagination={"mode": None}), "pagination.mode"),
    (document(pagination={"mode": 5}), "pagination.mode"),
    (document(pagination={"next_selector": " "}), "pagination.next_selector"),
    (document(pagination={"max_pages": 0.5}), "pagination.max_pages"),
    (document(pagination={"max_pages": None}), "pagination.max_pages"),
    (document(pagination={"url_template": "/{page}/{0}"}), "pagination.url_template"),
    (document(output=7), "output"),
    (document(output={"encoding": None}), "output.encoding"),
    (document(output={"deduplicate": 0}), "output.deduplicate"),
    (document(respect_robots_txt="true"), "respect_robots_txt"),
    (document(stop_on_error=1), "stop_on_error"),
    (document(start_url=None), "start_url"),
    (document(start_url=5), "start_url"),
    (document(item=[]), "item"),
    (document(item={"container": 3, "fields": [{"selector": "b"}]}), "item.container"),
    (document(item={"container": "a", "fields": {"selector": "b"}}), "item.fields"),
    ("{", ""),
    ("null", ""),
    ('"text"', ""),
]


def test_accepted(spark):
    assert problems(spark, *GOOD) == [set()] * len(GOOD)


def test_refused(spark):
    found = problems(spark, *(d for d, _ in BAD))
    assert [{path for path, _ in f} for f in found] == [{path} for _, path in BAD]


FIELD_CASES = [
    ({"selector": "dd.worth__net em"}, set(), "worth__net_em"),
    ({"selector": ".lot dt em"}, set(), "dt_em"),
    ({"selector": "b", "name": ""}, set(), "b"),
    ({"selector": "b", "name": 0}, set(), "b"),
    ({"selector": "b", "name": 7}, {"name"}, None),
    ({"selector": "b", "name": "  "}, {"name"}, None),
    ({"selector": "ul > -"}, set(), "ul_"),
    ({"selector": "-"}, set(), "-"),
    ({"selector": "#preț-2"}, set(), "preț-2"),
    ({"selector": "", "name": "x"}, {"selector"}, "x"),
    ({"selector": None, "name": "x"}, {"selector"}, "x"),
    ({"selector": "b", "transform": None}, {"transform"}, "b"),
    ({"selector": "b", "transform": "float", "attribute": None, "required": None}, set(), "b"),
    ({"selector": "b", "attribute": " "}, {"attribute"}, "b"),
    ({"selector": "b", "all": "yes"}, {"all"}, "b"),
    ({"selector": "b", "join_with": 5}, set(), "b"),
]


def test_field_rules(spark):
    documents = [document(item={"container": "a", "fields": [field]}) for field, _, _ in FIELD_CASES]
    found = problems(spark, *documents)
    assert [{path for path, _ in f} for f in found] == [{f"item.fields[0].{k}" for k in keys} for _, keys, _ in FIELD_CASES]
    rows = spec_fields(specs(spark, *documents)).orderBy("spec_id").collect()
    assert [r.name for r in rows] == [name for _, _, name in FIELD_CASES]


def test_defaults(spark):
    table = specs(spark, *(d for d, _ in CASES))
    rows = spec_fields(table).filter(f"spec_id = {THREE}").orderBy("field_no").collect()
    assert [tuple(r)[2:] for r in rows] == FIELDS[THREE]
    crawl = spec_crawls(table).filter(f"crawl_id = {PLAIN}").first()
    assert (crawl.mode, crawl.next_selector, crawl.start_page, crawl.max_pages, crawl.stop_on_error) == (
        "next", "a.next, .pagination a[rel=next]", 1, 10, True,
    )


def test_nothing_is_shuffled(spark):
    plan = spec_lint(specs(spark, document()))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


@pytest.mark.parametrize("count", [3])
def test_repeated_names_are_listed_once(spark, count):
    fields = [{"name": "t", "selector": "b"}] * count + [{"selector": "i"}, {"selector": "i"}]
    assert problems(spark, document(item={"container": "a", "fields": fields})) == [
        {("item.fields", "repeated name: t"), ("item.fields", "repeated name: i")}
    ]
