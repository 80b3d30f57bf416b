import random
from urllib.robotparser import RobotFileParser

from pyspark.sql import functions as F

from cardmill.operators import robots
from cardmill.operators.gate import classify, fetched_pages, resolve_attempts
from cardmill.operators.robots import (
    USER_AGENT,
    allowed_pages,
    robots_filter,
    robots_groups,
    robots_policy,
    robots_rules,
)

LOG = "url string, attempt int, status int, content_type string, body string, net_error string"
HTML = "text/html; charset=utf-8"


def log(spark, *rows):
    return spark.createDataFrame(list(rows), LOG)


def outcome(spark, retries, *rows):
    row = resolve_attempts(log(spark, *(("u", i + 1, *r) for i, r in enumerate(rows))), retries).first()
    return row.ok, row.status, row.problem, row.requests


def test_first_answer_is_a_page(spark):
    assert outcome(spark, 0, (200, HTML, "<p>", None)) == (True, 200, None, 1)


def test_busy_twice_then_page(spark):
    busy = (503, "text/plain", "x", None)
    assert outcome(spark, 2, busy, busy, (200, HTML, "<p>", None)) == (True, 200, None, 3)
    assert outcome(spark, 1, busy, busy, (200, HTML, "<p>", None)) == (False, 503, "HTTP 503", 2)


def test_client_error_ends_at_once(spark):
    page = (200, HTML, "<p>", None)
    assert outcome(spark, 3, (404, HTML, "x", None), page) == (False, 404, "HTTP 404", 1)
    assert outcome(spark, 3, (200, "application/json", "{}", None), page)[1:] == (
        200, "unexpected Content-Type: application/json", 1,
    )
    assert outcome(spark, 3, (200, HTML, "   \n", None), page) == (False, 200, "empty response", 1)


def test_timeout_is_tried_again(spark):
    assert outcome(spark, 0, (None, None, None, "timeout")) == (False, None, "timeout", 1)
    assert outcome(spark, 1, (None, None, None, None), (200, None, "x", None)) == (True, 200, None, 2)


def test_content_types(spark):
    kinds = {
        "TEXT/HTML": True, " text/html ;q": True, None: True, "": True, ";x": True, "text/plain": True,
        "application/xhtml+xml": True, "text/htmlx": True, "text": False, "image/png": False,
    }
    rows = classify(log(spark, *((str(k), 1, 200, k, "x", None) for k in kinds))).collect()
    assert {r.content_type: r.ok for r in rows} == kinds
    statuses = classify(log(spark, *(("u", s, s, HTML, "x", None) for s in range(400, 600)))).filter("retryable")
    assert {r.status for r in statuses.collect()} == {408, 425, 429, 500, 502, 503, 504}


def test_only_bodies_of_outcomes_are_pages(spark, monkeypatch):
    rows = [
        ("a", 1, 503, HTML, "busy", None), ("a", 2, 200, HTML, "page a", None), ("a", 3, 200, HTML, "again", None),
        ("b", 1, 404, HTML, "none", None), ("b", 2, 200, HTML, "too late", None), ("c", 1, 200, HTML, "page c", None),
    ]
    want = {("a", "page a"), ("c", "page c")}
    table = log(spark, *rows)
    assert {tuple(r) for r in fetched_pages(table, resolve_attempts(table)).collect()} == want
    monkeypatch.setattr("cardmill.operators.joins.BROADCAST_ROWS", 0)
    assert {tuple(r) for r in fetched_pages(table, resolve_attempts(table)).collect()} == want


def test_attempt_limit_is_applied_before_the_shuffle(spark):
    plan = resolve_attempts(log(spark, ("u", 1, 200, HTML, "x", None)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("WindowGroupLimit") == 2


BODIES = "origin string, robots_status int, body string"


def verdicts(spark, body, paths, status=200, agent=USER_AGENT):
    bodies = spark.createDataFrame([("https://x.test", status, body)], BODIES)
    urls = spark.createDataFrame([(i, f"https://x.test{p}") for i, p in enumerate(paths)], "i int, url string")
    return [r.allowed for r in robots_filter(urls, robots_policy(bodies, agent)).orderBy("i").collect()]


def test_plain_body(spark):
    body = "User-agent: *\nDisallow: /private\n"
    assert verdicts(spark, body, ["/private/secret", "/catalog?page=1", ""]) == [False, True, True]
    urls = spark.createDataFrame([("https://x.test/private",)], "url string")
    assert robots_filter(urls, urls, enabled=False).first().allowed


def test_statuses(spark):
    body = "User-agent: *\nDisallow: /private\n"
    for status, private, rest in [
        (401, False, False), (403, False, False), (404, True, True), (410, True, True), (500, False, False),
        (503, False, False), (None, True, True), (200, False, True),
    ]:
        assert verdicts(spark, body, ["/private", "/x"], status) == [private, rest], status


def test_unknown_origin_is_open(spark):
    bodies = spark.createDataFrame([("https://x.test", 403, "")], BODIES)
    urls = spark.createDataFrame([("https://y.test/a",)], "url string")
    assert robots_filter(urls, robots_policy(bodies)).first().allowed


def random_body(rng):
    agents = ["*", "mozilla", "Mozilla/5.0", "BadBot", "moz", "zilla # x"]
    paths = ["/", "/a", "/a/", "/a%2fb", "/a b", "/a%20b", "/é", "/%C3%A9", "/a?x=1", "/a?", "", "*", "/*", "/+", "/%2B"]
    lines = []
    for _ in range(rng.randrange(1, 14)):
        kind = rng.random()
        if kind < 0.25:
            lines.append(f"{rng.choice(['User-agent', 'user-AGENT '])}: {rng.choice(agents)}")
        elif kind < 0.7:
            lines.append(f"{rng.choice(['Disallow', 'Allow', ' disallow '])}:{rng.choice(['', ' '])}{rng.choice(paths)}")
        else:
            lines.append(rng.choice(["", "", " ", "# note", "Crawl-delay: 2", "Request-rate: 1/5", "Sitemap: /s", "text"]))
    return rng.choice(["\n", "\r\n", "\r"]).join(lines)


def test_against_the_standard_library(spark):
    rng = random.Random(11)
    paths = ["", "/", "/a", "/a/b", "/a%2Fb", "/ab", "/a%20b", "/a b", "/é", "/%c3%a9x", "/a?x=1", "/a?", "/+", "/%2b", "/*"]
    bodies = [(f"https://s{i}.test", 200, random_body(rng)) for i in range(300)]
    urls = [(f"{origin}{path}", origin) for origin, _, _ in bodies for path in paths]
    expected = {}
    for origin, _, body in bodies:
        parser = RobotFileParser()
        parser.parse(body.splitlines())
        for path in paths:
            expected[origin + path] = parser.can_fetch(USER_AGENT, origin + path)
    policy = robots_policy(spark.createDataFrame(bodies, BODIES))
    got = robots_filter(spark.createDataFrame(urls, "url string, origin string"), policy).collect()
    text = {origin: body for origin, _, body in bodies}
    wrong = [(r.url, text[r.origin], r.allowed) for r in got if r.allowed != expected[r.url]]
    assert wrong == []
    assert len(set(expected.values())) == 2


def test_rule_table(spark):
    body = "User-agent: a\nUser-agent: b\nDisallow: /x # c\n\nUser-agent: *\nAllow: /\nDisallow:\n"
    rules = robots_rules(robots_groups(spark.createDataFrame([("o", 200, body)], BODIES)))
    assert sorted((r.group_no, tuple(r.agents), r.rule_no, r.allow, r.path) for r in rules.collect()) == [
        (1, ("a", "b"), 1, False, "/x"), (2, ("*",), 1, True, "/"), (2, ("*",), 2, True, ""),
    ]


def test_pages_are_gated_alike_with_small_and_large_policies(spark, monkeypatch):
    bodies = spark.range(50).selectExpr(
        "concat('https://s', id, '.test') as origin", "200 as robots_status",
        "concat('User-agent: *\nDisallow: /', id % 3) as body",
    )
    policy = robots_policy(bodies)
    # One origin owns most pages.
    pages = spark.range(3000).selectExpr(
        "id as page_id", "concat('https://s', if(id % 3 = 0, id % 50, 7), '.test/', id % 4, '/', id) as url", "'x' as html"
    )
    small = {r.page_id for r in allowed_pages(pages, policy).collect()}
    monkeypatch.setattr("cardmill.operators.joins.BROADCAST_ROWS", 0)
    monkeypatch.setattr("cardmill.operators.joins.SMALL_ROWS", 10)
    large = {r.page_id for r in allowed_pages(pages, policy).collect()}
    want = {r.page_id for r in pages.filter(
        F.expr("split(url, '/')[3] <> cast(regexp_extract(url, 's([0-9]+)', 1) % 3 as int)")).collect()}
    assert small == large == want


def test_long_lists_of_rules_are_met_by_prefix(spark, monkeypatch):
    """The same verdicts as by looking through the rules, for short, long and repeated ones."""
    chance = random.Random(3)
    bodies, urls = [], []
    for site in range(4):
        paths = ["".join(chance.choices("ab/", k=chance.randrange(1, 6))) for _ in range(120)]
        lines = [f"{chance.choice(['Allow', 'Disallow'])}: /{path}" for path in paths]
        bodies.append((f"https://s{site}.test", 200 if site else 403, "User-agent: *\n" + "\n".join(lines[: 120 if site % 2 else 5])))
        urls += [(f"https://s{site}.test/" + "".join(chance.choices("ab/", k=chance.randrange(8))),) for _ in range(200)]
    urls += [(None,), ("https://elsewhere.test/a",), ("https://s1.test",), ("https://s1.test/",)]
    policy = robots.robots_policy(spark.createDataFrame(bodies, "origin string, robots_status int, body string"))
    table = spark.createDataFrame(urls, "url string")

    def verdicts():
        return sorted(((r["url"] or "", r["allowed"]) for r in robots.robots_filter(table, policy).collect()), key=str)

    long = verdicts()
    assert len(long) == len(urls) and len({allowed for _, allowed in long}) == 2
    pages = table.filter("url is not null").selectExpr("url", "'x' as html").distinct()
    kept = robots.allowed_pages(pages, policy).count()
    monkeypatch.setattr(robots, "SCANNED", 10**6)
    assert verdicts() == long and robots.allowed_pages(pages, policy).count() == kept
