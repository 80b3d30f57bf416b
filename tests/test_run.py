"""Runs that parse what they visit, against a plain walker."""

import json
import random
from collections import Counter

import pytest

from cardmill import FieldRule, PageRules, PagerRules
from cardmill.operators import joins
from cardmill.operators.run import fixed_runs, read_records, run_crawls, run_output, run_records, spec_runs, write_output
from cardmill.operators.stats import crawl_stats
from cardmill.session import new_dir
from cardmill.sources import page_store
from cardmill.sources.page_store import LOG, as_log, open_store, write_store
from cardmill.sources.pages import read_crawls, seed_problems

SITE = "https://fen.test"
RULES = PageRules("li.f", (FieldRule("name", "b", required=True), FieldRule("size", "i", transform="int")))
PAGER = PagerRules("a.on", "a.leaf")


def html(cards, onward=None, leaves=()):
    items = "".join(f'<li class="f">{f"<b>{name}</b>" if name else ""}<i>{size}</i>' for name, size in cards)
    links = "".join(f'<a class="leaf" href="{leaf}">x</a>' for leaf in leaves)
    return f"<ul>{items}</ul>{links}" + (f'<a class="on" href="{onward}">on</a>' if onward else "")


def walker(pages, crawl):
    """Visits of one crawl, page by page: ``(n, url, ok, found, kept)``."""
    url, been, visits = crawl["start_url"], [], []
    while url is not None and len(visits) < crawl["max_pages"] and url not in been:
        been.append(url)
        page = pages.get(url)
        kept = sum(bool(name) for name, _ in page[0]) if page else 0
        visits.append((len(visits) + 1, url, page is not None, len(page[0]) if page else 0, kept))
        if page is None and (crawl["stop_on_error"] or crawl["mode"] != "template"):
            break
        if page is not None and not kept:
            break
        if crawl["mode"] == "template":
            url = crawl["url_template"].replace("{page}", str(crawl["start_page"] + len(visits)))
            if url == crawl["start_url"]:
                break
        elif crawl["mode"] == "next":
            url = page[1]
        elif crawl["mode"] == "links":
            url = next((leaf for leaf in page[2] if leaf not in been), None)
        else:
            url = None
    return visits


def random_site(chance, size=14):
    names = [f"{SITE}/{chance.choice('ab')}?page={k}" for k in range(size)] + [f"{SITE}/c/{k}" for k in range(size // 2)]
    names = sorted(set(names))
    pages = {}
    for name in names:
        if chance.random() < 0.85:
            cards = [(chance.choice(["", "x", "y"]), chance.choice(["3", "4.5", "?"])) for _ in range(chance.choice([0, 1, 2, 3, 3]))]
            number = int(name.split("page=")[1]) if "page=" in name else None
            following = f"{name.split('page=')[0]}page={number + 1}" if number is not None and chance.random() < 0.7 else chance.choice([*names, None])
            pages[name] = (cards, following, chance.sample(names, chance.randrange(4)))
    return names, pages


@pytest.mark.parametrize("seed, ahead, broadcast", [(1, 32, 200_000), (2, 1, 200_000), (3, 4, 0)])
def test_random_sites(spark, monkeypatch, seed, ahead, broadcast):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", broadcast)
    chance = random.Random(seed)
    names, pages = random_site(chance)
    crawls = [
        {"crawl_id": k, "start_url": chance.choice(names), "mode": mode, "max_pages": chance.choice([1, 3, 9, 40]),
         "stop_on_error": chance.random() < 0.5, "start_page": chance.randrange(3), "url_template": f"{SITE}/{chance.choice('ab')}?page={{page}}"}
        for k, mode in enumerate(["next", "links", "template", "none"] * 12)
    ]
    seeds = spark.createDataFrame([tuple(c.values()) for c in crawls], "crawl_id long, start_url string, mode string, max_pages long, stop_on_error boolean, start_page long, url_template string")
    table = spark.createDataFrame([(url, html(*page)) for url, page in pages.items()], "url string, html string")
    store = write_store(as_log(table), new_dir(spark, "store"), shards=5)
    run = run_crawls(fixed_runs(read_crawls(seeds), RULES, PAGER), store, ahead=ahead)
    found = Counter((r["crawl_id"], r["n"], r["url"], r["ok"], r["found"], r["kept"]) for r in run.visited().collect())
    wanted = Counter((c["crawl_id"], *visit) for c in crawls for visit in walker(pages, c))
    assert found == wanted
    parsed, visits = run.read.filter("parsed").count(), run.visits.count()
    assert parsed <= 2 * visits + len(crawls)
    if ahead == 1:
        assert parsed == sum(n for (*_, ok, _, _), n in wanted.items() if ok)


def spec(number, **more):
    fields = [{"name": "name", "selector": "b", "required": True}]
    return {"start_url": f"{SITE}/{number}?page=1", "item": {"container": "li.f", "fields": fields}, **more}


ROBOTS = [(SITE, 200, "User-agent: fenbot\nDisallow: /2\n\nUser-agent: *\nDisallow: /3")]


def run_specs(spark, specs, log, robots=None, **options):
    table = spark.createDataFrame([(k, json.dumps(s)) for k, s in specs], "spec_id string, spec_json string")
    store = write_store(spark.createDataFrame(log, LOG), new_dir(spark, "store"), shards=3)
    bodies = None if robots is None else spark.createDataFrame(robots, "origin string, robots_status int, body string")
    return run_crawls(spec_runs(table), store, bodies, **options)


def page(url, cards=(("x", "1"),), **links):
    return (url, 1, 200, "text/html", html(cards, **links), None)


def test_settings_of_each_spec(spark):
    """Rules, attempts, content types, agents and outputs differ from spec to spec; broken ones do not run."""
    prices = {"container": "li.f", "fields": [{"name": "size", "selector": "i", "transform": "float"}, {"selector": "b", "required": True}]}
    specs = [
        ("a", spec(1, pagination={"mode": "next", "next_selector": "a.on"})),
        ("b", spec(2, user_agents=["FenBot/1.0"])),
        ("c", spec(2, user_agents="other/2")),
        ("d", spec(3)),
        ("e", spec(3, respect_robots_txt=False)),
        ("f", spec(4, retries=1)),
        ("g", spec(4, retries=2, item=prices, output={"path": "g.csv", "append": True})),
        ("h", spec(5)),
        ("i", spec(5, allowed_content_types=["Application/JSON"])),
        ("j", spec(6)),
        ("k", spec(1, item={"container": "li:hover", "fields": [{"selector": "b"}]})),
        ("l", {"start_url": "ftp://fen.test"}),
        ("m", spec(1)), ("m", spec(1)), (None, spec(1)),
    ]
    log = [page(f"{SITE}/1?page=1", onward="?page=2"), page(f"{SITE}/1?page=2", cards=[("x", "2"), ("", "3")])]
    log += [page(f"{SITE}/{k}?page=1") for k in (2, 3)]
    url = f"{SITE}/4?page=1"
    log += [(url, k, 503, None, "busy", None) for k in (1, 2)] + [(url, 3, 200, None, html([("y", "1,5"), ("y", "1,5"), ("z", "no")]), None)]
    log += [(f"{SITE}/5?page=1", 1, 200, " application/json; v=1", html([("x", "1")]), None)]
    log += [(f"{SITE}/6?page=1", 1, 200, "text/html", "  \n", None)]
    run = run_specs(spark, specs, log, ROBOTS)
    stats = {r["crawl_id"]: r for r in crawl_stats(run.visited(), ["record"]).collect()}
    told = {k: (r["pages"], r["rows"], r["skipped"], r["duplicates"], r["requests"], r["finish_reason"], r["first_errors"]) for k, r in stats.items()}
    assert told == {
        "a": (2, 2, 1, 1, 2, "no_next", []),
        "b": (1, 0, 0, 0, 0, "error", [f"{SITE}/2?page=1: denied by robots.txt"]),
        "c": (1, 1, 0, 0, 1, "no_next", []),
        "d": (1, 0, 0, 0, 0, "error", [f"{SITE}/3?page=1: denied by robots.txt"]),
        "e": (1, 1, 0, 0, 1, "no_next", []),
        "f": (1, 0, 0, 0, 2, "error", [f"{url}: HTTP 503"]),
        "g": (1, 3, 0, 1, 3, "no_next", []),
        "h": (1, 0, 0, 0, 1, "error", [f"{SITE}/5?page=1: unexpected Content-Type: application/json"]),
        "i": (1, 1, 0, 0, 1, "no_next", []),
        "j": (1, 0, 0, 0, 1, "error", [f"{SITE}/6?page=1: empty response"]),
        "k": (1, 0, 0, 0, 1, "no_items", ["unsupported selector: 'li:hover'"]),
    }
    records = {(r["crawl_id"], r["n"], r["card_no"]): r["record"] for r in run_records(run).collect()}
    assert records["g", 1, 1] == '{"size":"1.5","b":"y"}' and records["g", 1, 3] == '{"size":"","b":"z"}'
    folder = new_dir(spark, "out")
    write_output(run_output(run), folder)
    kept = Counter((r["output_path"], r["crawl_id"], r["record"]) for r in read_records(spark, folder).collect())
    assert kept["g.csv", "g", '{"size":"1.5","b":"y"}'] == 1 and kept["data/result.csv", "a", '{"name":"x"}'] == 1
    # Once more: only the spec that appends looks at what is there.
    again = Counter((r["crawl_id"], r["record"]) for r in run_output(run, read_records(spark, folder)).collect())
    assert ("g", '{"size":"1.5","b":"y"}') not in again and again["a", '{"name":"x"}'] == 1


def test_no_specs_no_pages(spark):
    assert run_specs(spark, [], []).visited().collect() == []
    run = run_specs(spark, [("a", spec(1)), ("b", spec(2, pagination={"mode": "template", "url_template": "t{page}", "max_pages": 3}, stop_on_error=False))], [])
    found = sorted((r["crawl_id"], r["n"], r["error"]) for r in run.visited().collect())
    assert found == [
        ("a", 1, f"{SITE}/1?page=1: not in the snapshot"), ("b", 1, f"{SITE}/2?page=1: not in the snapshot"),
        ("b", 2, "t2: not in the snapshot"), ("b", 3, "t3: not in the snapshot"),
    ]


def test_store_reads_only_the_shards_asked_for(spark):
    log = spark.createDataFrame([page(f"{SITE}/{k}") for k in range(60)], LOG)
    path = new_dir(spark, "store")
    write_store(log, path, shards=16)
    store = open_store(spark, path)
    assert store.shards == 16
    asked = spark.createDataFrame([(f"{SITE}/7",), (f"{SITE}/7",), (f"{SITE}/none",), (None,)], "url string")
    found = store.attempts(asked)
    assert [r["url"] for r in found.collect()] == [f"{SITE}/7"]
    assert len({part.rsplit("/", 2)[1] for part in found.inputFiles()}) <= 3 or "PartitionFilters: [shard" in plan(found)
    assert page_store.SHARD_PAGES > 0


def plan(df):
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_seeds_with_repeated_or_missing_ids(spark):
    rows = [("a", SITE), ("b", SITE), ("b", SITE), (None, SITE), (None, SITE), ("c", "nowhere")]
    seeds = spark.createDataFrame(rows, "crawl_id string, start_url string")
    assert [r["crawl_id"] for r in read_crawls(seeds).collect()] == ["a"]
    problems = Counter((r["crawl_id"], r["problem"]) for r in seed_problems(seeds).collect())
    assert problems == {("b", "crawl_id is repeated"): 2, (None, "crawl_id is missing"): 2, ("c", "start_url is not an http(s) address"): 1}


def test_rounds_grow_with_the_digits_of_a_walk(spark):
    size = 150
    pages = [(f"{SITE}/a?page={k}", html([("x", "1")], f"?page={k + 1}" if k < size else None, [f"?page={n}" for n in (1, k - 1, k, k + 1) if 0 < n <= size])) for k in range(1, size + 1)]
    store = write_store(as_log(spark.createDataFrame(pages, "url string, html string")), new_dir(spark, "store"), shards=2)
    seeds = spark.createDataFrame([(7, f"{SITE}/a?page=1", "links", size + 2, f"{SITE}/a?page={{page}}")], "crawl_id long, start_url string, mode string, max_pages long, url_template string")
    run = run_crawls(fixed_runs(read_crawls(seeds), RULES, PAGER), store)
    visits = sorted((r["n"], r["url"]) for r in run.visits.collect())
    assert visits[:size] == [(k, f"{SITE}/a?page={k}") for k in range(1, size + 1)] and len(visits) == size
    # 2, 4, 8, ... 128 pages.
    assert run.read.select("round").distinct().count() == 7
