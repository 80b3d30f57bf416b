"""robots.txt bodies as a rule table, and the URLs they allow.

The semantics are those of Python's ``urllib.robotparser``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import after_origin, origin, unquote
from ..functions.values import strip
from ..session import materialise
from .joins import drop_keys, fits_broadcast, lookup

# Line breaks, directives that complete a group, first user agent.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
RULES = ("allow", "disallow")
GROUP_BODY = ("allow", "disallow", "crawl-delay", "request-rate")
#: Rules of an origin that are looked through one by one.
SCANNED = 64
USER_AGENT = (
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/125.0.0.0 Safari/537.36"
)


def robots_groups(bodies: DataFrame) -> DataFrame:
    """``origin, robots_status, body`` → one row per group of rules.

    A group starts at an agent line that does not follow another one; an empty
    line ends it, and rules outside a group do not count. The windows run over
    the lines of one body.
    """
    lines = bodies.select("origin", F.posexplode(F.split("body", LINE_BREAK)).alias("line_no", "line"))
    text = F.regexp_replace("line", r"(?s)#.*\z", "")
    key = F.when(F.col("line") == "", "blank").when(
        F.contains(text, F.lit(":")), F.lower(strip(F.substring_index(text, ":", 1)))
    )
    value = unquote(strip(F.regexp_replace(text, r"(?s)\A[^:]*:", "")))
    lines = lines.select("origin", "line_no", key.alias("key"), value.alias("value")).filter(
        F.col("key").isin("blank", "user-agent", *GROUP_BODY)
    )
    body = Window.partitionBy("origin").orderBy("line_no")
    is_agent, is_blank = F.col("key") == "user-agent", F.col("key") == "blank"
    follows_agent = F.coalesce(F.lag("key").over(body) == "user-agent", F.lit(False))
    lines = (
        lines.withColumn("starts", is_agent & ~follows_agent)
        .withColumn("group_no", F.sum(F.col("starts").cast("int")).over(body))
        .withColumn("block", F.sum(is_blank.cast("int")).over(body))
        .withColumn("agent_block", F.last(F.when(is_agent, F.col("block")), ignorenulls=True).over(body))
        .filter(~is_blank & (F.col("block") == F.col("agent_block")))
    )
    allow = (F.col("key") == "allow") | (F.col("value") == "")
    rule = F.when(F.col("key").isin(*RULES), F.struct("line_no", allow.alias("allow"), F.col("value").alias("path")))
    groups = lines.groupBy("origin", "group_no").agg(
        F.collect_set(F.when(is_agent, F.col("value"))).alias("agents"),
        F.array_sort(F.collect_list(rule)).alias("rules"),
        F.bool_or(~is_agent).alias("complete"),
    )
    rules = F.transform("rules", lambda r: F.struct(r["allow"].alias("allow"), _tidy(r["path"]).alias("path")))
    return groups.filter("complete").select(
        "origin", F.col("group_no").cast("int").alias("group_no"), F.array_sort("agents").alias("agents"),
        rules.alias("rules"),
    )


def _tidy(path: Column) -> Column:
    """An empty query or fragment leaves no mark."""
    return F.regexp_replace(F.regexp_replace(path, r"#\z", ""), r"\?(?=#|\z)", "")


def robots_rules(groups: DataFrame) -> DataFrame:
    """One row per rule, in the order of the file."""
    exploded = groups.select("origin", "group_no", "agents", F.posexplode("rules").alias("rule_no", "rule"))
    return exploded.select(
        "origin", "group_no", "agents", (F.col("rule_no") + 1).alias("rule_no"), "rule.allow", "rule.path"
    )


def robots_policy(bodies: DataFrame, user_agent: str = USER_AGENT) -> DataFrame:
    """``origin, closed, rules``: what one agent must heed at every origin.

    The first group naming the agent counts, else the first ``*`` group. A body
    refused with 401/403 or a server error closes the origin; other client
    errors and connection errors (null status) leave it open. The result is a
    written table: it is measured and joined several times.
    """
    token = user_agent.split("/")[0].lower()
    is_default = F.array_contains("agents", "*")
    named = ~is_default & F.exists("agents", lambda agent: F.contains(F.lit(token), F.lower(agent)))
    readable = bodies.filter(F.col("robots_status").between(200, 399))
    chosen = robots_groups(readable).groupBy("origin").agg(
        F.coalesce(
            F.min_by("rules", F.when(named, F.col("group_no"))),
            F.min_by("rules", F.when(is_default, F.col("group_no"))),
        ).alias("rules")
    )
    status = F.col("robots_status")
    closed = F.coalesce(status.isin(401, 403) | (status >= 500), F.lit(False))
    return materialise(bodies.select("origin", closed.alias("closed")).join(chosen, "origin", "left"), "policy")


def robots_sites(bodies: DataFrame) -> DataFrame:
    """``origin, closed, groups``: what all agents must heed at every origin, for ``agent_rules``.

    A written table; the groups of an origin are those of its one body.
    """
    readable = bodies.filter(F.col("robots_status").between(200, 399))
    group = F.struct("group_no", "agents", "rules")
    groups = robots_groups(readable).groupBy("origin").agg(F.array_sort(F.collect_list(group)).alias("groups"))
    status = F.col("robots_status")
    closed = F.coalesce(status.isin(401, 403) | (status >= 500), F.lit(False))
    return materialise(bodies.select("origin", closed.alias("closed")).join(groups, "origin", "left"), "sites")


def agent_rules(user_agent: Column) -> Column:
    """The rules for an agent in a row that carries its origin's ``groups``: its first group, else the first ``*``."""
    token = F.lower(F.substring_index(user_agent, "/", 1))
    default = F.filter("groups", lambda g: F.array_contains(g["agents"], "*"))
    named = F.filter(
        "groups",
        lambda g: ~F.array_contains(g["agents"], "*") & F.exists(g["agents"], lambda agent: F.contains(token, F.lower(agent))),
    )
    return F.coalesce(F.get(named, F.lit(0))["rules"], F.get(default, F.lit(0))["rules"])


def rule_path(url: Column) -> Column:
    """What rules look at: the decoded URL behind its origin."""
    path = _tidy(after_origin(unquote(url)))
    return F.when(path == "", F.lit("/")).otherwise(path)


def is_allowed(url: Column) -> Column:
    """Verdict for a row that carries its origin's ``closed`` and ``rules``."""
    path = rule_path(url)
    first = F.get(F.filter("rules", lambda rule: F.startswith(path, rule["path"])), F.lit(0))
    return ~F.coalesce("closed", F.lit(False)) & F.coalesce(first["allow"], F.lit(True))


def robots_filter(urls: DataFrame, policy: DataFrame, enabled: bool = True) -> DataFrame:
    """Adds ``allowed`` to a table of URLs; an origin may own most of the rows.

    Up to ``SCANNED`` rules travel with their origin's row. Longer lists are met by hash: see
    ``prefix_verdicts``.
    """
    if not enabled:
        return urls.withColumn("allowed", F.lit(True))
    site = origin(F.col("url")).alias("__origin")
    long = F.coalesce(F.size("rules") > SCANNED, F.lit(False))
    short = policy.select(
        F.col("origin").alias("__origin"), "closed", F.when(~long, F.col("rules")).alias("rules"), long.alias("__long")
    )
    joined = lookup(urls.select("*", site), short, "__origin")
    listed = materialise(policy.filter(long & ~F.col("closed")), "long-rules")
    if listed.isEmpty():
        return joined.withColumn("allowed", is_allowed(F.col("url"))).select(*urls.columns, "allowed")
    verdicts = prefix_verdicts(urls, listed).withColumnRenamed("url", "__url")
    joined = joined.join(F.broadcast(verdicts) if fits_broadcast(verdicts) else verdicts, F.col("url") == F.col("__url"), "left")
    allowed = F.when(F.col("__long") & ~F.col("closed"), F.coalesce("__allow", F.lit(True))).otherwise(is_allowed(F.col("url")))
    return joined.withColumn("allowed", allowed).select(*urls.columns, "allowed")


def prefix_verdicts(urls: DataFrame, policy: DataFrame) -> DataFrame:
    """``url, __allow`` of the distinct URLs that one of their origin's rules names, by the first such rule.

    A path is looked up by those of its own beginnings that are as long as some rule of its
    origin, so the work for an URL is the number of different lengths, not of rules. Rules
    of one path count as the first of them. The result is a written table.
    """
    rules = policy.select(F.col("origin").alias("__origin"), F.posexplode("rules").alias("rule_no", "rule"))
    rules = rules.select("__origin", F.col("rule.path").alias("prefix"), "rule_no", F.col("rule.allow").alias("allow"))
    rules = rules.groupBy("__origin", "prefix").agg(F.min(F.struct("rule_no", "allow")).alias("rule"))
    rules = materialise(rules, "rules")
    lengths = rules.groupBy("__origin").agg(F.collect_set(F.char_length("prefix")).alias("lengths"))
    distinct = urls.select("url").distinct().select("url", origin(F.col("url")).alias("__origin"), rule_path(F.col("url")).alias("path"))
    lengths = materialise(lengths, "lengths")
    distinct = distinct.join(F.broadcast(lengths) if fits_broadcast(lengths) else lengths, "__origin")
    size = F.char_length("path")
    begins = F.transform(F.filter("lengths", lambda n: n <= size), lambda n: F.substring(F.col("path"), F.lit(1), n))
    asked = distinct.select("url", "__origin", F.explode(begins).alias("prefix"))
    met = asked.join(F.broadcast(rules) if fits_broadcast(rules) else rules, ["__origin", "prefix"])
    first = met.groupBy("url").agg(F.min("rule").alias("rule"))
    return materialise(first.select("url", F.col("rule.allow").alias("__allow")), "verdicts")


def allowed_pages(pages: DataFrame, policy: DataFrame) -> DataFrame:
    """Pages that may be read, decided before they are parsed.

    A policy table of proven small size goes to every task. A larger one, or one with long
    lists of rules, meets only the URLs, and the denied ones are taken out by key.
    """
    most = policy.agg(F.max(F.size("rules"))).first()[0] or 0
    if most <= SCANNED and fits_broadcast(policy):
        keyed = pages.withColumn("__origin", origin(F.col("url")))
        joined = keyed.join(F.broadcast(_keyed(policy)), "__origin", "left")
        return joined.filter(is_allowed(F.col("url"))).select(*pages.columns)
    denied = robots_filter(pages.select("url"), policy).filter("not allowed").select("url").distinct()
    return drop_keys(pages, denied, "url")


def _keyed(policy: DataFrame) -> DataFrame:
    return policy.select(F.col("origin").alias("__origin"), "closed", "rules")
