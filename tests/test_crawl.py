"""Walks on small link graphs, also along the paths for large ones."""

import pytest

from cardmill import FieldRule, PageRules, PagerRules
from cardmill.operators import crawl as walks
from cardmill.operators import joins
from cardmill.operators.clean import clean_records, duplicate_counts
from cardmill.operators.crawl import crawl, crawl_records, preview, site_facts
from cardmill.operators.extract import page_facts, parse_pages, records
from cardmill.operators.gate import fetched_pages, resolve_attempts
from cardmill.operators.robots import allowed_pages, robots_policy
from cardmill.operators.stats import crawl_stats
from cardmill.sources.csv_output import read_output, write_records
from cardmill.sources.pages import read_crawls, seed_problems

BASE = "https://reeds.test"
RULES = PageRules(
    "li.reed",
    (
        FieldRule("name", "a.nm", required=True),
        FieldRule("cost", "em", transform="price"),
        FieldRule("where", "a.nm", "href", "url"),
        FieldRule("score", "meta", "content", "float"),
    ),
)
PAGER = PagerRules("a[rel=next]", "a.leaf")
NAMELESS = '<li class="reed"><em>€3</em>'


def reed(n):
    """Reed n of the stock: seven units and n twenties of a cent each, and no score for every third."""
    score = f'<meta content="{n}.25">' if n % 3 else ""
    return f'<li class="reed"><em>€{7 * n},{n}5</em> <a class="nm" href="../reed-{n}">Reed {chr(64 + n)}</a>{score}'


def stock(page, pages=4):
    """Page k lists two reeds; page 3 has one without a name as well."""
    reeds = [reed(2 * page - 1), reed(2 * page)] + ([NAMELESS] if page == 3 else [])
    leaves = " ".join(f'<a class="leaf" href="{i}">{i}</a>' for i in range(1, pages + 1))
    onward = f'<a rel="next" href="{page + 1}">on</a>' if page < pages else '<a rel="next" class="disabled" href="1">on</a>'
    return f"<h1>Stock</h1><ol>{''.join(reeds)}</ol><footer>{leaves} {onward}</footer>"


SITE = {f"{BASE}/stock/{p}": stock(p) for p in (1, 2, 3, 4)} | {
    f"{BASE}/bare": "<h1>Stock</h1><p>Sold out until May.",
    f"{BASE}/nameless": f"<ol>{NAMELESS}{NAMELESS}</ol>",
    f"{BASE}/stock/staff": stock(1),
    f"{BASE}/void": " \n ",
}


def table(spark, site=SITE, **options):
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(site.items())], "page_id long, url string, html string")
    return site_facts(page_facts(parse_pages(pages, RULES, PAGER), RULES), **options)


def seeds(spark, **columns):
    row = {"crawl_id": "c", "start_url": f"{BASE}/stock/1", "max_pages": 30, **columns}
    return read_crawls(spark.createDataFrame([row]))


def run(spark, facts=None, policy=None, **columns):
    visited = crawl(seeds(spark, **columns), table(spark) if facts is None else facts, policy)
    return visited, crawl_stats(visited, RULES.names).first()


def urls(visited):
    return [r.url.removeprefix(BASE) for r in visited.orderBy("n").collect()]


STOCK = ["/stock/1", "/stock/2", "/stock/3", "/stock/4"]


def test_whole_stock(spark, tmp_path):
    visited, stats = run(spark)
    assert (stats.pages, stats.containers, stats.skipped, stats.rows, stats.duplicates, stats.requests) == (4, 9, 1, 8, 0, 4)
    assert (stats.errors, stats.first_errors, stats.finish_reason) == (0, [], "no_next")
    rows = crawl_records(visited, RULES.names).orderBy("n", "card_no").collect()
    assert tuple(rows[0])[4:] == ("Reed A", "7.15", f"{BASE}/reed-1", "1.25")
    assert tuple(rows[-1])[4:] == ("Reed H", "56.85", f"{BASE}/reed-8", "8.25")
    write_records(crawl_records(visited, RULES.names), str(tmp_path / "deep" / "out"), RULES.names)
    assert read_output(spark, str(tmp_path / "deep" / "out"), RULES.names).count() == 8


@pytest.mark.parametrize(
    ("columns", "visits", "reason", "errors"),
    [
        ({"max_pages": 3}, STOCK[:3], "max_pages", 0),
        ({"max_pages": 4}, STOCK, "max_pages", 0),
        ({"start_url": f"{BASE}/stock/3"}, STOCK[2:], "no_next", 0),
        ({"start_url": f"{BASE}/bare"}, ["/bare"], "no_items", 1),
        ({"start_url": f"{BASE}/nameless"}, ["/nameless"], "empty_rows", 0),
        ({"start_url": f"{BASE}/void"}, ["/void"], "error", 1),
        ({"start_url": f"{BASE}/gone"}, ["/gone"], "error", 1),
        ({"start_url": f"{BASE}/gone", "stop_on_error": False}, ["/gone"], "no_next", 1),
        ({"start_url": f"{BASE}/gone", "stop_on_error": False, "max_pages": 1}, ["/gone"], "max_pages", 1),
        ({"mode": "none"}, STOCK[:1], "no_next", 0),
        ({"mode": "links"}, STOCK, "no_next", 0),
        ({"mode": "links", "start_url": f"{BASE}/stock/4"}, [STOCK[i] for i in (3, 0, 1, 2)], "no_next", 0),
        ({"mode": "links", "start_url": f"{BASE}/stock/staff"}, ["/stock/staff", *STOCK], "no_next", 0),
        ({"mode": "template", "url_template": f"{BASE}/stock/{{page}}"}, [*STOCK, "/stock/5"], "error", 1),
        ({"mode": "template", "url_template": f"{BASE}/stock/{{page}}", "max_pages": 2}, STOCK[:2], "max_pages", 0),
        # Page 2 of the template is the start page again.
        ({"mode": "template", "url_template": f"{BASE}/stock/{{page}}", "start_page": 3,
          "start_url": f"{BASE}/stock/4"}, ["/stock/4"], "no_next", 0),
        ({"mode": "template", "url_template": f"{BASE}/gone/{{page}}", "start_url": f"{BASE}/gone/1",
          "stop_on_error": False, "max_pages": 5}, [f"/gone/{i}" for i in range(1, 6)], "max_pages", 5),
        ({"mode": "template", "url_template": f"{BASE}/{{page}}", "start_url": f"{BASE}/void",
          "stop_on_error": False, "max_pages": 3}, ["/void", "/2", "/3"], "max_pages", 3),
    ],
)
def test_walks(spark, columns, visits, reason, errors):
    visited, stats = run(spark, **columns)
    assert urls(visited) == visits
    assert (stats.pages, stats.finish_reason, stats.errors) == (len(visits), reason, errors)


def test_messages(spark):
    assert "li.reed" in run(spark, start_url=f"{BASE}/bare")[1].first_errors[0]
    assert run(spark, start_url=f"{BASE}/gone")[1].first_errors == [f"{BASE}/gone: not in the snapshot"]
    assert run(spark, start_url=f"{BASE}/void")[1].first_errors == [f"{BASE}/void: empty response"]


SEEDS = "crawl_id string, start_url string, mode string, max_pages long, url_template string"


def test_seeds_are_checked(spark):
    rows = [
        ("bare", "reeds.test", None, None, None), ("ftp", "ftp://reeds.test", None, None, None), ("none", None, None, None, None),
        ("blank", " \t", None, None, None), ("mode", "https://reeds.test", "Next", None, None),
        ("limit", "https://reeds.test", None, 0, None), ("template", "https://reeds.test", "template", None, "/x"),
        ("good", "\t https://reeds.test\n", None, None, None), ("upper", "HTTP://reeds.test", "none", 3, None),
    ]
    table = spark.createDataFrame(rows, SEEDS)
    kept = read_crawls(table).orderBy("crawl_id").collect()
    assert [(r.crawl_id, r.start_url, r.mode, r.max_pages, r.stop_on_error) for r in kept] == [
        ("good", "https://reeds.test", "next", 10, True),
    ]
    problems = {r.crawl_id: r.problem for r in seed_problems(table).collect()}
    assert problems == {
        "bare": "start_url is not an http(s) address", "ftp": "start_url is not an http(s) address",
        "upper": "start_url is not an http(s) address",
        "none": "start_url is missing", "blank": "start_url is missing", "mode": "unknown mode: Next",
        "limit": "max_pages must be at least 1", "template": "url_template lacks {page}",
    }


def test_no_seeds_and_odd_modes(spark):
    facts = table(spark)
    assert walks.walk(seeds(spark).limit(0), facts).collect() == []
    assert walks.walk(seeds(spark).selectExpr("* except (max_pages)", "0L as max_pages"), facts).collect() == []
    with pytest.raises(ValueError, match="unknown mode"):
        walks.walk(seeds(spark).selectExpr("* except (mode)", "'Next' as mode"), facts)


def test_preview(spark):
    rows = preview(seeds(spark, start_url=f"{BASE}/stock/3"), table(spark), ["name"], limit=1).collect()
    assert [(r.found, r.card_no, r.name) for r in rows] == [(3, 1, "Reed E")]


ROBOTS = "origin string, robots_status int, body string"


def test_fetch_log_and_robots(spark):
    log = [(u, 1, 200, "text/html", h, None) for u, h in SITE.items() if u != f"{BASE}/stock/2"]
    log += [(f"{BASE}/stock/2", 1, 503, "text/html", "x", None), (f"{BASE}/stock/2", 2, 200, None, stock(2), None)]
    log += [(f"{BASE}/ill", a, 502, None, "x", None) for a in (1, 2)]
    log = spark.createDataFrame(log, "url string, attempt int, status int, content_type string, body string, net_error string")
    policy = robots_policy(spark.createDataFrame([(BASE, 200, "User-agent: *\nDisallow: /stock/staff\n")], ROBOTS))
    outcomes = resolve_attempts(log, 1)
    pages = allowed_pages(fetched_pages(log, outcomes), policy)
    read = page_facts(parse_pages(pages, RULES, PAGER, keep=["url"]), RULES, keep=["url"])
    facts = site_facts(read, outcomes)
    _, stats = run(spark, facts, policy)
    assert (stats.pages, stats.rows, stats.requests, stats.errors) == (4, 8, 5, 0)
    _, stats = run(spark, facts, policy, start_url=f"{BASE}/stock/staff")
    assert (stats.pages, stats.rows, stats.requests, stats.finish_reason) == (1, 0, 0, "error")
    assert stats.first_errors == [f"{BASE}/stock/staff: denied by robots.txt"]
    _, stats = run(spark, facts, policy, start_url=f"{BASE}/ill")
    assert (stats.pages, stats.requests, stats.finish_reason) == (1, 2, "error")
    assert "HTTP 502" in stats.first_errors[0]
    # Without the rules nobody says that the page was denied: it was fetched, and is not here.
    _, stats = run(spark, facts, start_url=f"{BASE}/stock/staff")
    assert (stats.requests, stats.first_errors) == (1, [f"{BASE}/stock/staff: not in the snapshot"])


@pytest.mark.parametrize("mode", ["next", "links"])
def test_policy_denies_on_facts_of_all_pages(spark, mode):
    policy = robots_policy(spark.createDataFrame([(BASE, 200, "User-agent: *\nDisallow: /stock/3\n")], ROBOTS))
    visited, stats = run(spark, policy=policy, mode=mode)
    assert urls(visited) == STOCK[:3]
    assert (stats.rows, stats.requests, stats.errors, stats.finish_reason) == (4, 2, 1, "error")
    denied = visited.filter("n = 3").first()
    assert (denied.ok, denied.found, denied.kept, denied.kept_cards) == (False, 0, 0, None)


def test_reported_errors(spark):
    columns = {"mode": "template", "url_template": f"{BASE}/gone/{{page}}", "stop_on_error": False, "max_pages": 15}
    visited, stats = run(spark, start_url=f"{BASE}/gone/1", **columns)
    assert stats.errors == 15
    assert stats.first_errors == [f"{BASE}/gone/{i}: not in the snapshot" for i in range(1, 11)]
    assert len(crawl_stats(visited, RULES.names, reported=12).first().first_errors) == 12


def test_duplicates_are_counted_per_crawl(spark):
    twice = {f"{BASE}/a": reed(1) + reed(1) + reed(2) + '<a rel="next" href="/b">', f"{BASE}/b": reed(2)}
    _, stats = run(spark, table(spark, twice), start_url=f"{BASE}/a")
    assert (stats.rows, stats.duplicates) == (4, 2)


NAMES = ("url", "page_id", "card_no", "n", "found", "copies", "first", "fresh", "known", "crawl_id", "price.rub", "__row")


@pytest.mark.parametrize("name", NAMES)
def test_any_field_name(spark, tmp_path, name):
    rules = PageRules("li.reed", (FieldRule(name, "a.nm", required=True), FieldRule("cost", "em")))
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(SITE.items())], "page_id long, url string, html string")
    parsed = parse_pages(pages, rules, PAGER)
    assert records(parsed, rules).filter(f"`{name}` = 'Reed B'").count() == 2
    visited = crawl(seeds(spark), site_facts(page_facts(parsed, rules)))
    stats = crawl_stats(visited, rules.names).first()
    assert (stats.rows, stats.duplicates) == (8, 0)
    found = crawl_records(visited, rules.names)
    out = str(tmp_path / "out")
    write_records(found, out, rules.names)
    assert read_output(spark, out, rules.names).filter(f"`{name}` = 'Reed B'").count() == 1
    again = duplicate_counts(clean_records(found, rules.names), rules.names, existing=read_output(spark, out, rules.names))
    assert again.first().duplicates == 8


def test_few_visits_do_not_move_the_table(spark):
    """The table's payload is scanned for the visits' keys, never exchanged."""
    facts = spark.range(60_000).selectExpr("concat('u', id) as url", "repeat('x', 30) as payload")
    visits = spark.createDataFrame([(f"u{i}",) for i in range(25)], "url string")
    joined = joins.lookup(visits, facts, "url", written=True)
    assert joined.filter("payload is not null").count() == 25
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan


# A graph of many crawls: chains, a ring, and one page most walks run through.
GRAPH = "url string, ok boolean, found long, kept long, next_url string, pager_urls array<string>"


def graph(spark):
    edges = {f"h{i}": "h0" for i in range(1, 400)} | {f"n{i}": f"n{i + 1}" for i in range(70)}
    edges |= {f"r{i}": f"r{(i + 1) % 7}" for i in range(7)} | {"h0": "r3", "self": "self"}
    rows = [(u, True, 1, 1, v, [u, v, "n5"]) for u, v in edges.items()]
    rows += [("n70", True, 1, 1, None, []), ("dead", True, 1, 0, "n0", ["n0"])]
    return spark.createDataFrame(rows, GRAPH), {u: (v, links) for u, _, _, kept, v, links in rows if kept}


def expected_walk(nodes, mode, start, depth):
    path = [start]
    while len(path) < depth and path[-1] in nodes:
        following, links = nodes[path[-1]]
        options = links if mode == "links" else [following]
        fresh = [u for u in options if u is not None and u not in path]
        if not fresh:
            break
        path.append(fresh[0])
    return path


@pytest.mark.parametrize("mode", ["next", "links"])
@pytest.mark.parametrize("large", [False, True])
def test_many_walks(spark, mode, large, monkeypatch):
    facts, nodes = graph(spark)
    starts = [*(f"h{i}" for i in range(400)), "n0", "n3", "n69", "r0", "r5", "self", "dead", "nowhere"]
    crawls = spark.createDataFrame(
        [(i, mode, s, d) for i, (s, d) in enumerate((s, d) for s in starts for d in (1, 3, 50))],
        "crawl_id long, mode string, start_url string, max_pages long",
    )
    split = []
    if large:
        monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(joins, "SMALL_ROWS", 50)
        monkeypatch.setattr(joins.F, "broadcast", lambda df, real=joins.F.broadcast: split.append(1) or real(df))
    got = {}
    for row in walks.walk(crawls, facts).collect():
        got.setdefault(row.crawl_id, []).append((row.n, row.url))
    for i, (start, depth) in enumerate((s, d) for s in starts for d in (1, 3, 50)):
        path = expected_walk(nodes, mode, start, depth)
        assert sorted(got[i]) == list(enumerate(path, 1)), (start, depth)
    if large:
        assert split  # the hot page was met on its own


def test_modes_mix_and_long_templates_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(walks, "CHUNK", 7)
    monkeypatch.setattr(joins, "SMALL_ROWS", 10)
    found = [(f"t{i}", True, 1, 1, None, []) for i in range(1, 41) if i != 25]
    facts = spark.createDataFrame([*found, ("t41", True, 0, 0, None, [])], GRAPH)
    rows = [
        ("stop", "template", "t1", "t{page}", 1, 100, True), ("on", "template", "t1", "t{page}", 1, 100, False),
        ("short", "template", "s", "t{page}", 3, 9, True), ("one", "none", "t9", None, 1, 9, True),
        ("again", "template", "t9", "t{page}", 1, 100, True),
    ]
    crawls = spark.createDataFrame(
        rows, "crawl_id string, mode string, start_url string, url_template string, start_page long, max_pages long, stop_on_error boolean"
    )
    got = {}
    for row in walks.walk(crawls, facts).collect():
        got.setdefault(row.crawl_id, []).append((row.n, row.url))
    expected = {
        "stop": [f"t{i}" for i in range(1, 26)],
        "on": [f"t{i}" for i in range(1, 42)],
        "short": ["s"],
        "one": ["t9"],
        "again": ["t9", *(f"t{i}" for i in range(2, 9))],
    }
    assert {k: [u for _, u in sorted(v)] for k, v in got.items()} == expected
    assert sorted(got["on"])[0][0] == 1


def test_hot_keys_meet_the_broadcast_rows_only(spark, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(joins, "SMALL_ROWS", 10)
    df = spark.range(1000).selectExpr("id", "if(id % 3 = 0, 'hot', if(id % 50 = 1, null, concat('k', id))) as k")
    lookup_table = spark.range(2000).selectExpr("if(id = 0, 'hot', concat('k', id)) as k", "id as v").filter("v % 7 <> 1")
    for how in ("left", "inner"):
        want = df.join(lookup_table, "k", how)
        got = joins.lookup(df, lookup_table, "k", how)
        assert "Union" in got._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(map(str, got.select("id", "k", "v").collect())) == sorted(map(str, want.select("id", "k", "v").collect()))


def test_placed_edges_are_not_moved_again(spark, monkeypatch):
    monkeypatch.setattr(walks, "FEW_EDGES", 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = walks.place_by_url(graph(spark)[0].select("url", "pager_urls"))
        state = spark.range(9).selectExpr("id as crawl_id", "9 as max_pages", "concat('n', id) as url")
        state = state.selectExpr("*", "array(url) as seen", "false as done")
        for _ in range(2):
            state = walks._advance(state.join(edges, "url", "left"))
        plan = state._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 2
        # Two for the frontier, and the one inside the cached table shown under each of its uses.
        assert plan.count("ENSURE_REQUIREMENTS") == 2
        edges.unpersist()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_template_walks_ask_for_twice_their_visits_at_most(spark, monkeypatch):
    """Blocks of numbers double, so a limit of a million numbers costs nothing."""
    monkeypatch.setattr(walks, "FIRST_BLOCK", 2)
    site = {f"{BASE}/t/{k}": stock(1) for k in range(1, 12)}
    asked = []
    block = walks._block
    monkeypatch.setattr(walks, "_block", lambda crawls, facts, low, size: asked.append((low, size)) or block(crawls, facts, low, size))
    seed = {"mode": "template", "url_template": f"{BASE}/t/{{page}}", "start_url": f"{BASE}/t/1", "max_pages": 1_000_000}
    visited = crawl(seeds(spark, **seed), table(spark, site))
    assert urls(visited) == [f"/t/{k}" for k in range(1, 13)]
    assert asked == [(1, 2), (3, 4), (7, 8)]


def test_only_reachable_edges_are_composed(spark):
    """Sites that no walk comes to do not count, ways from site to site do."""
    other = [(f"https://o{k}.test/1", f"https://o{k}.test/2") for k in range(50)]
    own = [(f"{BASE}/1", f"{BASE}/2"), (f"{BASE}/2", "https://far.test/1"), ("https://far.test/1", "https://farther.test/1"), ("https://farther.test/1", f"{BASE}/3")]
    edges = spark.createDataFrame(other + own, "url string, far string")
    assert sorted(map(tuple, walks.reachable(edges, seeds(spark, start_url=f"{BASE}/1")).collect())) == sorted(own)
    assert walks.reachable(edges, seeds(spark, start_url=f"{BASE}/1"), rounds=1).count() == len(other) + len(own)


def test_known_rows_in_most_crawls(spark, monkeypatch):
    """A row that most crawls have is looked up by broadcast; counts stay the same."""
    monkeypatch.setattr(joins, "SMALL_ROWS", 0)
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    rows = [(k, "everywhere", "") for k in range(300) for _ in range(2)] + [(k, f"own {k}", "") for k in range(0, 300, 3)]
    df = spark.createDataFrame(rows, "crawl_id long, a string, b string")
    known = spark.createDataFrame([("everywhere", ""), ("everywhere", ""), ("own 6", "")], "a string, b string")
    found = {r["crawl_id"]: r["duplicates"] for r in duplicate_counts(df, ["a", "b"], ["crawl_id"], known).collect()}
    assert found == {k: 3 if k == 6 else 2 for k in range(300)}


def test_long_walks_along_links_take_blocks(spark, monkeypatch):
    """Pagers of numbered pages; walk 2 leaves the numbers for a while, walk 3 stays off them."""
    monkeypatch.setattr(walks, "LEVELS", 8)
    monkeypatch.setattr(walks, "LEVELS_AT_ONCE", 8)
    levels = []
    advance = walks._advance
    monkeypatch.setattr(walks, "_advance", lambda joined: levels.append(1) or advance(joined))

    def number(site, k):
        return f"https://{site}.test/?page={k}"

    nodes = {number("a", k): [number("a", n) for n in (1, k - 2, k - 1, k, k + 1, k + 2) if 0 < n <= 60] for k in range(1, 61)}
    nodes |= {number("b", k): [number("b", n) for n in (1, k - 1, k + 1) if 0 < n <= 24] for k in range(1, 25)}
    nodes[number("b", 13)] = [number("b", 20)]
    nodes |= {f"https://c.test/{k}": [f"https://c.test/{n}" for n in (k - 1, (k * 5) % 14, k + 1)] for k in range(14)}
    rows = [(url, True, 1, 1, None, links) for url, links in nodes.items()]
    facts = spark.createDataFrame(rows, "url string, ok boolean, found long, kept long, next_url string, pager_urls array<string>")
    seeds = [(1, number("a", 1), 100), (2, number("b", 1), 100), (3, "https://c.test/0", 12), (4, number("a", 5), 30), (5, number("a", 3), 5)]
    crawls = spark.createDataFrame([(k, url, "links", most, None, 1, True) for k, url, most in seeds], "crawl_id long, start_url string, mode string, max_pages long, url_template string, start_page long, stop_on_error boolean")
    want = []
    for k, url, most in seeds:
        path = [url]
        while len(path) < most and (link := next((n for n in nodes.get(path[-1], []) if n not in path), None)):
            path.append(link)
        want += [(k, n, url) for n, url in enumerate(path, 1)]
    assert sorted(map(tuple, walks.walk(crawls, facts).collect())) == sorted(want)
    # Level by level it were 60.
    assert len(levels) <= 40
