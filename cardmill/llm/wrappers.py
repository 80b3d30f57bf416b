"""Main text of web pages by wrappers: union-free regular expressions of a host's pages (operator 10).

Pages of a host are aligned as token streams, kept as trees of elements and texts. Where
two pages agree, the wrapper has their common markup; a text that differs becomes a
slot, siblings that repeat become a repeated group, and what only one of them has
becomes optional. Merging wrappers works like merging pages, so tasks infer wrappers of
the pages they hold, and wrappers of a host are merged in rounds of a bounded fan-in: a
host with a third of all pages is spread like any other, and pages never move.

A wrapper says which texts belong to the template (the same wherever they occur, and on
several distinct pages) and which element holds the variable text. A page's text is what that element holds; if it
lies in an article or main element, all of that; if articles or main elements in it have
most of its text, these. Only hosts with too few pages for a wrapper, and pages without
the element, go by their own tags: the longest article, main element or body. Elements
known by name as menus, adverts, forms, notices or comments are left out. Of an article or
main element nothing else is: headings, bylines or quotes that many pages share stay. Where
the wrapper alone says what the region is, boxes in it that hold template texts and no
variable text on any page go.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import deque
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import fits_broadcast
from ..operators.markup import ATTRIBUTE, CLOSES, RAW_END, TOKEN, VOID
from ..session import materialise
from .arrow import slices, texts, type_of

#: Wrappers of one host that are merged by one task in one round.
FAN = 64
#: Distinct pages that must agree on a text before it counts as the template's.
AGREE = 5
#: Nested elements that are kept as such; deeper ones lie in the last of them.
DEEPEST = 150
#: Bits of alignment held at once; longer lists of siblings are split first.
CELLS = 1 << 28
#: Longer texts are kept in wrappers by a digest.
LONG = 64
#: Hosts that a task holds before it passes their wrappers on.
HOSTS = 4000

#: Elements that are parts of a text and never the region that holds it.
PARTS = frozenset(
    "p h1 h2 h3 h4 h5 h6 hgroup header ul ol li dl dt dd pre blockquote table caption thead tbody tfoot tr td th figure figcaption "
    "details summary address".split()
)
#: Inline elements do not end a block of text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q rb ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
NEVER = frozenset(
    "head title script style noscript template nav aside form footer button select option optgroup input textarea iframe "
    "object embed svg canvas menu dialog audio video map datalist".split()
)
RAW = frozenset("script style textarea title noscript template iframe".split())
RAW_ENDS = {**RAW_END, **{name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW if name not in RAW_END}}
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner sidebar "
    "sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead topbar cookie cookies consent gdpr "
    "notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login share shares sharing "
    "social comment comments commentlist disqus reply replies respond discussion related recommended recommendations "
    "widget widgets toolbar pagination pager outbrain taboola copyright".split()
)
#: Words that say nothing about what an element holds: with a word of ``NOISE`` they make a name of noise.
BOXES = frozenset(
    "box boxes block blocks list lists item items link links wrap wrapper container section area bar buttons button icon icons "
    "post posts article articles story stories content unit slot form module panel inner outer group row col column top bottom left "
    "right header main page site view el js".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
REMARK = frozenset("comment comments reply replies commentlist".split())
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

SLOT = None
#: The place of the open article and main elements among the counts of open tags.
WITHIN = "<"


class Element:
    __slots__ = ("tag", "key", "noise", "kids", "main")

    def __init__(self, tag: str, key: str, noise: bool, main: bool = False):
        self.tag, self.key, self.noise, self.main, self.kids = tag, key, noise, main, []


def _names_noise(label: str) -> bool:
    """Whether a whole class or id names noise: ``ad-slot`` does, ``related-work`` does not."""
    parts = {part.lower() for part in PART.findall(label)}
    return bool(parts & NOISE) and parts <= NOISE | BOXES


def _element(tag: str, raw: str, inside: bool = False) -> Element:
    """An element; ``inside`` an article or main element a class or id counts as a whole, else by its parts."""
    key, noise, main = tag, tag in NEVER, tag == "main"
    if raw and not raw.isspace():
        found: dict[str, str] = {}
        for name, double, single, bare in ATTRIBUTE.findall(raw):
            found.setdefault(name.lower(), double or single or bare)
        labels = unescape(f"{found.get('id', '')} {found.get('class', '')}")
        if labels != " ":
            key += "." + ".".join(sorted(set(re.sub(r"\d+", "", labels).split())))
        words = {part.lower() for part in PART.findall(labels)}
        role = found.get("role", "").lower()
        main = main or role == "main" or found.get("itemprop", "").lower() == "articlebody"
        if tag == "article":
            noise = bool(words & REMARK) and not words & {"post", "entry", "hentry", "article", "story"}
        elif tag not in ("html", "body", "main") and not main:
            hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true"
            named = any(map(_names_noise, labels.split())) if inside else bool(words & NOISE)
            noise = noise or named or role in ROLES or hidden
    return Element(tag, key, noise, main)


def page_tree(html: str) -> Element:
    """A tolerant tree: elements and texts (white space kept), without comments, scripts and styles."""
    root = Element("", "", False)
    stack, opened = [root], {WITHIN: 0}
    limit = html.rfind(">") + 1
    position, tokens = 0, TOKEN.finditer(html, 0, limit)

    def text(value: str) -> None:
        if value:
            stack[-1].kids.append(unescape(value) if "&" in value else value)

    def leave(depth: int) -> None:
        while len(stack) > depth:
            gone = stack.pop()
            opened[gone.tag] -= 1
            opened[WITHIN] -= gone.main or gone.tag == "article"

    while (token := next(tokens, None)) is not None:
        if token.start() > position:
            text(html[position : token.start()])
        position = token.end()
        closing, opening, raw = token.group(2, 3, 4)
        if opening is not None:
            tag = opening.lower()
            if tag in CLOSES:
                closed, scope = CLOSES[tag]
                if any(map(opened.get, closed)):
                    for depth in range(len(stack) - 1, 0, -1):
                        if stack[depth].tag in closed:
                            leave(depth)
                            break
                        if stack[depth].tag in scope:
                            break
            element = _element(tag, raw, opened[WITHIN] > 0)
            if tag in RAW:
                stop = RAW_ENDS[tag].search(html, position, limit)
                position = stop.end() if stop else len(html)
                tokens = TOKEN.finditer(html, position, limit)
            else:
                stack[-1].kids.append(element)
                if tag not in VOID and len(stack) < DEEPEST:
                    stack.append(element)
                    opened[tag] = opened.get(tag, 0) + 1
                    opened[WITHIN] += element.main or tag == "article"
        elif closing is not None:
            tag = closing.lower()
            if opened.get(tag):
                depth = len(stack) - 1
                while stack[depth].tag != tag:
                    depth -= 1
                leave(depth)
    rest = html[position:]
    broken = re.search(r"</?[a-zA-Z]|<!--", rest)
    text(rest[: broken.start()] if broken else rest)
    return root


# A wrapper node is [key, optional, repeated, kids] for an element or a group (key "()"),
# and ["#", optional, repeated, value or SLOT, characters, marks] for a text: the marks of pages
# that hold this value there, AGREE of them at most.


def page_mark(html: str) -> int:
    """The same for copies of a page, whichever task reads them."""
    return int.from_bytes(hashlib.blake2b(html.encode("utf-8", "surrogatepass"), digest_size=8).digest())


def _sign(value: str) -> str:
    """A text as wrappers keep it; no text with its white space collapsed looks like a digest."""
    if len(value) <= LONG:
        return value
    return "\n" + hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def _united(one: list[int], two: list[int]) -> list[int]:
    """The least marks of both: AGREE of them just if so many distinct pages are behind them."""
    return one if one == two else sorted({*one, *two})[:AGREE]


def expression(element: Element, mark: int = 0) -> list:
    kids = []
    for kid in element.kids:
        if isinstance(kid, str):
            value = " ".join(kid.split())
            if value:
                kids.append(["#", False, False, _sign(value), len(value), [mark]])
        elif not kid.noise:
            kids.append(expression(kid, mark))
        else:
            kids.append([kid.key, False, False, []])
    return [element.key, False, False, folded(kids)]


def folded(kids: list) -> list:
    """Neighbours that repeat, one by one or in twos and threes, become a repeated group."""
    out: list = []
    for kid in kids:
        out.append(kid)
        for size in (1, 2, 3):
            if len(out) > size and out[-1 - size][0] == "()":
                group = out[-1 - size]
                if _keys(group[3]) == _keys(out[-size:]):
                    group[3] = [merged(a, b) for a, b in zip(group[3], out[-size:], strict=True)]
                    del out[-size:]
                    break
            if len(out) >= 2 * size and _keys(out[-size:]) == _keys(out[-2 * size : -size]) and kid[0] != "()":
                both = [merged(a, b) for a, b in zip(out[-2 * size : -size], out[-size:], strict=True)]
                out[-2 * size :] = [_repeated(both)]
                break
    return out


def _repeated(kids: list) -> list:
    if len(kids) == 1:
        return [kids[0][0], kids[0][1], True, *kids[0][3:]]
    return ["()", False, True, kids]


def _keys(kids: list) -> list:
    return [kid[0] if kid[0] != "()" else ("()", *_keys(kid[3])) for kid in kids]


def merged(one: list, two: list) -> list:
    """The expression of what either of two with the same key stands for."""
    optional, repeated = one[1] or two[1], one[2] or two[2]
    if one[0] == "#":
        if one[3] is SLOT or one[3] != two[3]:
            return ["#", optional, repeated, SLOT, one[4] + two[4], []]
        return ["#", optional, repeated, one[3], one[4] + two[4], _united(one[5], two[5])]
    return [one[0], optional, repeated, aligned(one[3], two[3])]


def _optional(kid: list) -> list:
    return [kid[0], True, *kid[2:]]


def _lines(one: list, two: list) -> Iterator[int]:
    """A row of the table of common lengths for each of ``one``: bit j is 0 where the length grows with ``two[j]``."""
    places: dict = {}
    for j, key in enumerate(two):
        places[key] = places.get(key, 0) | 1 << j
    line = full = (1 << len(two)) - 1
    for key in one:
        met = line & places.get(key, 0)
        line = ((line + met) | (line - met)) & full
        yield line


def _lengths(one: list, two: list) -> np.ndarray:
    """Length of the longest common subsequence of ``one`` and every start of ``two``."""
    line = deque(_lines(one, two), 1).pop()
    grows = np.frombuffer(format(line, f"0{len(two)}b").encode(), np.uint8)[::-1] == ord("0")
    return np.concatenate([[0], np.cumsum(grows)])


def common(one: list, two: list) -> list[tuple[int, int]]:
    """Places of a longest common subsequence of lists of any length."""
    stop = min(len(one), len(two))
    start = next((k for k in range(stop) if one[k] != two[k]), stop)
    tail = next((k for k in range(stop - start) if one[-1 - k] != two[-1 - k]), stop - start)
    found = [(k, k) for k in range(start)]
    end = [(len(one) - k, len(two) - k) for k in range(tail, 0, -1)]
    one, two = one[start : len(one) - tail], two[start : len(two) - tail]
    if not one or not two:
        return found + end
    if len(one) > 1 and len(one) * len(two) > CELLS:
        half = len(one) // 2
        cut = int(np.argmax(_lengths(one[:half], two) + _lengths(one[half:][::-1], two[::-1])[::-1]))
        found += [(start + i, start + j) for i, j in common(one[:half], two[:cut])]
        found += [(start + half + i, start + cut + j) for i, j in common(one[half:], two[cut:])]
        return found + end
    lines, between = list(_lines(one, two)), []
    i, j = len(one) - 1, len(two) - 1
    while i >= 0 and j >= 0:
        if one[i] == two[j]:
            between.append((start + i, start + j))
            i, j = i - 1, j - 1
        elif lines[i] >> j & 1:
            j -= 1
        else:
            i -= 1
    return found + between[::-1] + end


def aligned(one: list, two: list) -> list:
    """Siblings aligned by their longest common subsequence; the others are optional."""
    first, second = _keys(one), _keys(two)
    if first == second:
        return [merged(a, b) for a, b in zip(one, two, strict=True)]
    out, i, j = [], 0, 0
    for left, right in common(first, second):
        out += map(_optional, one[i:left] + two[j:right])
        out.append(merged(one[left], two[right]))
        i, j = left + 1, right + 1
    out += map(_optional, one[i:] + two[j:])
    # What is now side by side may repeat.
    return folded(out)


class Wrapper:
    """A wrapper, the number of pages behind it, and marks of AGREE distinct ones at most."""

    def __init__(self, root: list, pages: int, marks: list[int]):
        self.root, self.pages, self.marks = root, pages, marks

    @classmethod
    def of(cls, html: str) -> Wrapper:
        mark = page_mark(html)
        return cls(expression(page_tree(html), mark), 1, [mark])

    def merge(self, other: Wrapper) -> Wrapper:
        return Wrapper(merged(self.root, other.root), self.pages + other.pages, _united(self.marks, other.marks))

    def dump(self) -> str:
        return json.dumps([self.root, self.pages, self.marks], ensure_ascii=False, separators=(",", ":"))

    @classmethod
    def load(cls, text: str) -> Wrapper:
        return cls(*json.loads(text))

    def facts(self) -> tuple[set[tuple[tuple[str, ...], str]], tuple[str, ...] | None]:
        """Template texts of boxes with their paths, and the path of the element that holds the variable text."""
        fixed: set[tuple[tuple[str, ...], str]] = set()
        mass: dict[tuple[str, ...], int] = {}
        if len(self.marks) < AGREE:
            return fixed, None

        # Elements that a page has once, and that may hold a whole text.
        regions: set[tuple[str, ...]] = set()

        def walk(kids: list, path: tuple[str, ...], single: bool) -> None:
            for kid in kids:
                if kid[0] == "#":
                    if kid[3] is SLOT:
                        for size in range(1, len(path) + 1):
                            mass[path[:size]] = mass.get(path[:size], 0) + kid[4]
                    elif len(kid[5]) >= AGREE:
                        fixed.add((path, kid[3]))
                elif kid[0] == "()":
                    walk(kid[3], path, False)
                else:
                    here, tag = (*path, kid[0]), kid[0].partition(".")[0]
                    own = single and not kid[2] and tag not in PARTS and tag not in INLINE
                    if own:
                        regions.add(here)
                    walk(kid[3], here, own)

        walk(self.root[3], (), True)
        fixed = {(path, text) for path, text in fixed if _is_box(path, mass)}
        most = max(mass.values(), default=0)
        # The innermost element that has most of it.
        inner = max((path for path in regions if mass.get(path, 0) >= 0.8 * most), key=len, default=None) if mass else None
        return fixed, inner


def _is_box(path: tuple[str, ...], mass: dict[tuple[str, ...], int]) -> bool:
    """Whether the block around a text holds the same on all pages, is no part of a text, and lies outside article and main."""
    tags = [key.partition(".")[0] for key in path]
    size = next((k + 1 for k in range(len(tags) - 1, -1, -1) if tags[k] not in INLINE), 0)
    return not {"article", "main"} & set(tags) and (not size or tags[size - 1] not in PARTS) and not mass.get(path[:size], 0)


Place = tuple[Element, tuple[str, ...]]


def _regions(element: Element, path: tuple[str, ...], found: dict[str, list[Place]], inside: bool = False) -> None:
    """Outermost articles, and outermost main and body elements outside them."""
    for kid in element.kids:
        if isinstance(kid, str) or kid.noise:
            continue
        here = (*path, kid.key)
        if kid.tag == "article":
            found["article"].append((kid, here))
            continue
        if kid.main and not inside:
            found["main"].append((kid, here))
        if kid.tag == "body":
            found["body"].append((kid, here))
        _regions(kid, here, found, inside or kid.main)


def _wanted(element: Element, path: tuple[str, ...], wanted: tuple[str, ...], article: Place | None, main: Place | None) -> Iterator[Place]:
    """Elements at the wanted path, or the outermost article or innermost main element that each lies in."""
    for kid in element.kids:
        if isinstance(kid, str) or kid.noise or kid.key != wanted[len(path)]:
            continue
        here = (*path, kid.key)
        own_article = article or ((kid, here) if kid.tag == "article" else None)
        own_main = (kid, here) if kid.main else main
        if len(here) == len(wanted):
            yield own_article or own_main or (kid, here)
        else:
            yield from _wanted(kid, here, wanted, own_article, own_main)


def _by_wrapper(root: Element, fixed: set, wanted: tuple[str, ...]) -> list[Place]:
    """What holds the text by the wrapper: its region or, if they have most of that, the articles or main elements in it."""
    regions = list({id(one[0]): one for one in _wanted(root, (), wanted, None, None)}.values())
    found: dict[str, list[Place]] = {"article": [], "main": [], "body": []}
    for region, path in regions:
        if region.tag != "article":
            _regions(region, path, found)
    if found["article"] or found["main"]:
        half = sum(len(_blocks(*one, fixed, "wrapper")) for one in regions) / 2
        for kind in ("article", "main"):
            if found[kind] and sum(len(_blocks(*one, fixed, kind)) for one in found[kind]) >= half:
                return found[kind]
    return regions


def main_text(html: str, fixed: set, wanted: tuple[str, ...] | None) -> str:
    """The text of a page by the facts of its host's wrapper, by its own tags if there are none or nothing is there."""
    root = page_tree(html)
    if wanted:
        blocks = (_blocks(*one, fixed, "wrapper") for one in _by_wrapper(root, fixed, wanted))
        if text := " ".join(block for block in blocks if block):
            return text
    found: dict[str, list[Place]] = {"article": [], "main": [], "body": []}
    _regions(root, (), found)
    for kind in ("article", "main", "body"):
        if found[kind]:
            region, path = max(found[kind], key=lambda one: _length(one[0]))
            text = _blocks(region, path, fixed, kind)
            if text:
                return text
    return _blocks(root, (), fixed, "body")


def _length(element: Element) -> int:
    return sum(len(kid) if isinstance(kid, str) else 0 if kid.noise else _length(kid) for kid in element.kids)


def _blocks(region: Element, path: tuple[str, ...], fixed: set, kind: str) -> str:
    blocks: list[str] = []
    line: list[str] = []
    if region.main or region.tag == "article":
        fixed = set()

    def flush() -> None:
        text = " ".join("".join(line).split())
        line.clear()
        if text:
            blocks.append(text)

    def walk(element: Element, path: tuple[str, ...]) -> None:
        for kid in element.kids:
            if isinstance(kid, str):
                value = " ".join(kid.split()) if fixed else ""
                if not value or (path, _sign(value)) not in fixed:
                    line.append(kid)
                continue
            if kid.noise or (kid.tag == "header" and kind == "body"):
                flush()
                continue
            if kid.tag in INLINE:
                walk(kid, (*path, kid.key))
                continue
            flush()
            walk(kid, (*path, kid.key))
            flush()

    walk(region, path)
    flush()
    return " ".join(blocks)


def host_of(url) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]*)", 1), F.lit("")))


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """``host, wrapper, pages``: one wrapper for each host in ``pages`` (``url, html``)."""

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Wrapper] = {}
        seen: set[tuple[str, int]] = set()
        for batch in slices(batches, 128):
            for host, html in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                # Copies of a page agree on everything and say nothing.
                mark = (host, page_mark(html))
                if html and mark not in seen:
                    seen.add(mark)
                    own = Wrapper.of(html)
                    held[host] = held[host].merge(own) if host in held else own
            if len(held) > HOSTS:
                yield _rows(held)
                held.clear()
                seen.clear()
        yield _rows(held)

    found = pages.select(host_of(pages["url"]).alias("host"), pages["html"]).mapInArrow(infer, "host string, wrapper string, pages long")
    found = materialise(found, "wrappers")

    def merge(group: pa.Table) -> pa.Table:
        whole = None
        for text in group.column("wrapper").to_pylist():
            whole = Wrapper.load(text) if whole is None else whole.merge(Wrapper.load(text))
        return pa.table({"host": [group.column("host")[0].as_py()], "wrapper": [whole.dump()], "pages": [whole.pages]})

    while True:
        most = found.groupBy("host").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if most < 2:
            return found
        # Each round leaves a part in so many of a host's rows, and one row in the end.
        parts = -(-most // FAN)
        dealt = found.withColumn("part", F.pmod(F.xxhash64("wrapper", F.monotonically_increasing_id()), F.lit(parts)))
        found = materialise(dealt.groupBy("host", "part").applyInArrow(merge, "host string, wrapper string, pages long"), "wrappers")


def _rows(held: dict[str, Wrapper]) -> pa.RecordBatch:
    columns = [
        pa.array(list(held), pa.string()), pa.array([own.dump() for own in held.values()], pa.string()),
        pa.array([own.pages for own in held.values()], pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["host", "wrapper", "pages"])


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Facts of each host: wrappers hold every optional node, pages need only what is settled."""
    for batch in slices(batches, 1):
        fixed, inner = Wrapper.load(batch.column(1)[0].as_py()).facts()
        facts = json.dumps([sorted(fixed), inner], ensure_ascii=False, separators=(",", ":"))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([facts], pa.string())], ["__host", "facts"])


def _load_facts(text: str) -> tuple[set[tuple[tuple[str, ...], str]], tuple[str, ...] | None]:
    fixed, inner = json.loads(text)
    return {(tuple(path), value) for path, value in fixed}, None if inner is None else tuple(inner)


def extract_text(pages: DataFrame, wrappers: DataFrame | None = None) -> DataFrame:
    """``page_id, url, text``: the main text of every row of ``pages`` (``page_id, url, html``).

    Character references are decoded, white space inside a block is one space, blocks
    follow in page order with one space between. Null or empty html, and pages without
    text, give an empty text. A null or odd url belongs to the host without a name;
    repeated rows give repeated rows; an empty table an empty result. Other columns are
    ignored, whatever their names.
    """
    wrappers = infer_wrappers(pages) if wrappers is None else wrappers
    wrappers = materialise(wrappers.select("host", "wrapper").mapInArrow(_facts, "__host string, facts string"), "facts")
    own = pages.select(pages["page_id"].alias("page_id"), pages["url"].alias("url"), pages["html"].alias("html"))
    own = own.withColumn("host", host_of(F.col("url")))
    rows = own.join(F.broadcast(wrappers) if fits_broadcast(wrappers) else wrappers, F.col("host") == F.col("__host"), "left")
    schema = f"page_id {type_of(own, 'page_id')}, url string, text string"

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        for batch in slices(batches, 128):
            found = []
            for host, facts, html in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), texts(batch.column(4)), strict=True):
                if host not in known:
                    if len(known) > HOSTS:
                        known.clear()
                    known[host] = (set(), None) if facts is None else _load_facts(facts)
                found.append(main_text(html, *known[host]) if html else "")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], ["page_id", "url", "text"])

    return rows.select("page_id", "url", "host", "facts", "html").mapInArrow(extract, schema)
