"""Tolerant element table of one page, and CSS matching on it.

Runs inside the extraction task only. A page becomes parallel lists in document
order: element ``i`` covers elements ``i .. end[i]-1`` and text pieces
``text_from[i] .. text_to[i]-1``, so "inside a card" is a range check and
attributes are only parsed for the elements a selector asks about.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable
from html import unescape

TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:(-->)|\Z))|<[!?][^>]*+>"
    r"|</([a-zA-Z][^\s/>]*+)[^>]*+>"
    r"|<([a-zA-Z][^\s/>]*+)"
    r"""((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+))?+)*+)>""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
OPEN_COMMENT = re.compile(r"<!--(?!-?>)")
UNFINISHED_TAG = re.compile(r"</?[a-zA-Z]|<!--")
# In an attribute "&section=" is no reference to "&sect;".
REFERENCE = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);")

# HTML element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset(("script", "style", "textarea", "title"))
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW_TEXT}
ENTITY_TEXT = frozenset(("textarea", "title"))
OWN_TEXT = frozenset(("script", "style", "template", "rt", "rp"))
BLOCK = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
# A start tag closes an open element of the first set unless one of
# the second set was opened after it.
P_SCOPE = frozenset("button caption td th table object template".split())
LISTS = frozenset("ul ol menu".split())
CLOSES = {
    "li": (frozenset(("li",)), LISTS),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "td": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "th": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "tr": (frozenset(("tr",)), frozenset(("table",))),
    "tbody": (frozenset(("thead", "tbody", "tfoot")), frozenset(("table",))),
    "tfoot": (frozenset(("thead", "tbody", "tfoot")), frozenset(("table",))),
    "option": (frozenset(("option",)), frozenset(("select", "optgroup"))),
    "optgroup": (frozenset(("optgroup",)), frozenset(("select",))),
    "body": (frozenset(("head",)), frozenset()),
    **{tag: (frozenset(("p",)), P_SCOPE) for tag in BLOCK},
}
# Attributes holding lists of words.
WORD_LISTS = {
    "class": None, "accesskey": None, "dropzone": None,
    "rel": {"a", "link", "area"}, "rev": {"a", "link"}, "headers": {"td", "th"},
    "accept-charset": {"form"}, "archive": {"object"}, "sizes": {"icon"},
    "sandbox": {"iframe"}, "for": {"output"},
}
# Elements whose value is an attribute, and which attributes to try.
VALUE_TAGS = frozenset("meta img input br hr source link".split())
VALUE_ATTRIBUTES = ("content", "src", "alt")


class Markup:
    """The elements of one page."""

    def __init__(self, html: str) -> None:
        self.tag: list[str] = []
        self.parent: list[int] = []
        self.end: list[int] = []
        self.text_from: list[int] = []
        self.text_to: list[int] = []
        self.texts: list[str] = []
        self.text_owner: list[str] = []
        self.by_tag: dict[str, list[int]] = {}
        self.raw: list[str] = []
        self._attrs: dict[int, dict[str, str]] = {}
        self._siblings: tuple[list[int], list[int]] | None = None
        self._scan(html)

    def _scan(self, html: str) -> None:
        tag, parent, end, raw = self.tag, self.parent, self.end, self.raw
        texts, text_from, text_to, by_tag = self.texts, self.text_from, self.text_to, self.by_tag
        stack: list[int] = []
        owners: list[str] = []
        # How many elements of a name are open: most searches of the stack need not start.
        opened: dict[str, int] = {}
        # Up to the last ">" every tag is complete, so no search runs to the end in vain.
        limit = html.rfind(">") + 1
        position, tokens = 0, TOKEN.finditer(html, 0, limit)
        while (token := next(tokens, None)) is not None:
            start = token.start()
            if start > position:
                self._add_text(html[position:start], owners)
            position = token.end()
            closing, opening, attributes = token.group(2, 3, 4)
            if opening is not None:
                name = opening.lower()
                if name in CLOSES:
                    closed, scope = CLOSES[name]
                    if any(map(opened.get, closed)):
                        self._close_open(stack, owners, opened, closed, scope)
                node = len(tag)
                tag.append(name)
                parent.append(stack[-1] if stack else -1)
                raw.append(attributes)
                end.append(node + 1)
                text_from.append(len(texts))
                text_to.append(len(texts))
                if name in by_tag:
                    by_tag[name].append(node)
                else:
                    by_tag[name] = [node]
                if name in RAW_TEXT:
                    position = self._add_raw_text(html, position, limit, name, owners)
                    text_to[node] = len(texts)
                    tokens = TOKEN.finditer(html, position, limit)
                elif name not in VOID:
                    stack.append(node)
                    opened[name] = opened.get(name, 0) + 1
                    if name in OWN_TEXT:
                        owners.append(name)
            elif closing is not None:
                name = closing.lower()
                if opened.get(name):
                    depth = len(stack) - 1
                    while tag[stack[depth]] != name:
                        depth -= 1
                    self._pop_to(stack, owners, opened, depth)
            elif position == limit and token.group(1) is None and OPEN_COMMENT.match(html, start):
                position = len(html)
        rest = html[position:]
        unfinished = UNFINISHED_TAG.search(rest)
        self._add_text(rest[: unfinished.start()] if unfinished else rest, owners)
        self._pop_to(stack, owners, opened, 0)

    def _add_raw_text(self, html: str, position: int, limit: int, name: str, owners: list[str]) -> int:
        """The text up to the element's own end tag; returns where to go on."""
        stop = RAW_END[name].search(html, position, limit)
        body = html[position : stop.start()] if stop else html[position:]
        if body:
            self.texts.append(unescape(body) if name in ENTITY_TEXT else body)
            self.text_owner.append(name if name in OWN_TEXT else owners[-1] if owners else "")
        return stop.end() if stop else len(html)

    def _pop_to(self, stack: list[int], owners: list[str], opened: dict[str, int], depth: int) -> None:
        while len(stack) > depth:
            node = stack.pop()
            name = self.tag[node]
            self.end[node] = len(self.tag)
            self.text_to[node] = len(self.texts)
            opened[name] -= 1
            if name in OWN_TEXT:
                owners.pop()

    def _close_open(self, stack, owners, opened, closed: frozenset, scope: frozenset) -> None:
        for depth in range(len(stack) - 1, -1, -1):
            name = self.tag[stack[depth]]
            if name in closed:
                self._pop_to(stack, owners, opened, depth)
                return
            if name in scope:
                return

    def _add_text(self, text: str, owners: list[str]) -> None:
        if text and not text.isspace():
            self.texts.append(unescape(text) if "&" in text else text)
            self.text_owner.append(owners[-1] if owners else "")

    def attrs(self, node: int) -> dict[str, str]:
        found = self._attrs.get(node)
        if found is None:
            found = {}
            for name, double, single, bare in ATTRIBUTE.findall(self.raw[node]):
                value = double or single or bare
                if "&" in value:
                    value = REFERENCE.sub(lambda m: unescape(m.group()), value)
                found.setdefault(name.lower(), value)
            self._attrs[node] = found
        return found

    def classes(self, node: int) -> list[str]:
        return self.attrs(node).get("class", "").split()

    def may_have(self, node: int, text: str) -> bool:
        """Whether the unparsed attributes hold ``text``, perhaps as references."""
        raw = self.raw[node]
        return text in raw or "&" in raw

    def siblings(self) -> tuple[list[int], list[int]]:
        """Previous element sibling (-1: none) and 1-based place among siblings."""
        if self._siblings is None:
            last: dict[int, int] = {}
            before, place = [], []
            for node, parent in enumerate(self.parent):
                previous = last.get(parent, -1)
                before.append(previous)
                place.append(1 if previous < 0 else place[previous] + 1)
                last[parent] = node
            self._siblings = before, place
        return self._siblings

    def is_last(self, node: int) -> bool:
        parent = self.parent[node]
        return self.end[node] == (self.end[parent] if parent >= 0 else len(self.tag))

    def text(self, node: int) -> str:
        own = self.tag[node] if self.tag[node] in OWN_TEXT else ""
        span = range(self.text_from[node], self.text_to[node])
        return " ".join(" ".join(self.texts[i].split()) for i in span if self.text_owner[i] == own).strip()

    def value(self, node: int, attribute: str | None) -> str:
        """The attribute; else the service attribute of an empty element; else the text."""
        if attribute:
            value = self.attrs(node).get(attribute, "")
            tags = WORD_LISTS.get(attribute, frozenset())
            return " ".join(value.split()) if tags is None or self.tag[node] in tags else value.strip()
        if self.tag[node] in VALUE_TAGS:
            attrs = self.attrs(node)
            return next((attrs[a] for a in VALUE_ATTRIBUTES if attrs.get(a)), "").strip()
        return self.text(node)

    def candidates(self, tag: str | None, low: int, high: int):
        if tag is None:
            return range(low, high)
        nodes = self.by_tag.get(tag, ())
        return nodes[bisect_left(nodes, low) : bisect_left(nodes, high)]


Check = Callable[[Markup, int], bool]
IDENT = r"(?:[\w-]|[^\x00-\x7f])+"
SIMPLE = re.compile(
    rf"\*|(?P<tag>{IDENT})|\#(?P<id>{IDENT})|\.(?P<cls>{IDENT})"
    rf"|\[\s*(?P<attr>{IDENT})\s*(?:(?P<op>[~^$*|]?=)\s*(?:\"(?P<dq>[^\"]*)\"|'(?P<sq>[^']*)'|(?P<bare>{IDENT}))\s*)?\]"
    rf"|:(?P<pseudo>first-child|last-child|nth-child\((?P<nth>[^()]*)\)|not\((?P<inner>[^()]*)\))"
)
COMBINATOR = re.compile(r"\s*([>+~,])\s*|\s+")
NTH = re.compile(r"\s*(?:(?P<word>odd|even)|(?:(?P<a>[+-]?\d*)n)?\s*(?P<b>[+-]?\s*\d+)?)\s*")
ATTRIBUTE_TESTS: dict[str, Callable[[str, str], bool]] = {
    "=": lambda have, want: have == want,
    "~=": lambda have, want: want in have.split(),
    "^=": lambda have, want: bool(want) and have.startswith(want),
    "$=": lambda have, want: bool(want) and have.endswith(want),
    "*=": lambda have, want: bool(want) and want in have,
    "|=": lambda have, want: have == want or have.startswith(want + "-"),
}


class Selector:
    """A comma list of chains; a chain is compounds linked by combinators."""

    def __init__(self, text: str) -> None:
        self.chains: list[list[tuple[str, str | None, list[Check]]]] = []
        position, text = 0, text.strip()
        chain: list[tuple[str, str | None, list[Check]]] = []
        link = " "
        while True:
            tag, checks, position = _compound(text, position)
            chain.append((link, tag, checks))
            if position == len(text):
                self.chains.append(chain)
                return
            joint = COMBINATOR.match(text, position)
            if joint is None or joint.end() == len(text):
                raise ValueError(f"unsupported selector: {text!r}")
            position, link = joint.end(), joint.group(1) or " "
            if link == ",":
                self.chains.append(chain)
                chain, link = [], " "

    def select(self, page: Markup, low: int = 0, high: int | None = None) -> list[int]:
        high = len(page.tag) if high is None else high
        found = [self._chain_nodes(page, chain, low, high) for chain in self.chains]
        return found[0] if len(found) == 1 else sorted(set().union(*found))

    def first(self, page: Markup, low: int = 0, high: int | None = None) -> int | None:
        high = len(page.tag) if high is None else high
        firsts = []
        for chain in self.chains:
            hits = (n for n in page.candidates(chain[-1][1], low, high) if _matches(page, n, chain, len(chain) - 1))
            firsts.append(next(hits, None))
        return min((n for n in firsts if n is not None), default=None)

    @staticmethod
    def _chain_nodes(page: Markup, chain, low: int, high: int) -> list[int]:
        last = len(chain) - 1
        return [n for n in page.candidates(chain[last][1], low, high) if _matches(page, n, chain, last)]


def _matches(page: Markup, node: int, chain, step: int) -> bool:
    link, tag, checks = chain[step]
    if (tag is not None and page.tag[node] != tag) or not all(check(page, node) for check in checks):
        return False
    if step == 0:
        return True
    near = page.parent if link in " >" else page.siblings()[0]
    other = near[node]
    while other >= 0:
        if _matches(page, other, chain, step - 1):
            return True
        if link in ">+":
            return False
        other = near[other]
    return False


def _compound(text: str, position: int) -> tuple[str | None, list[Check], int]:
    tag, checks, start = None, [], position
    while position < len(text):
        part = SIMPLE.match(text, position)
        if part is None or (part["tag"] and position > start):
            break
        if part["tag"]:
            tag = part["tag"].lower()
        elif part.group() != "*":
            checks.append(_check(part))
        position = part.end()
    if position == start:
        raise ValueError(f"unsupported selector: {text!r}")
    return tag, checks, position


def _check(part: re.Match) -> Check:
    if part["id"]:
        return lambda page, node, want=part["id"]: page.attrs(node).get("id") == want
    if part["cls"]:
        want = part["cls"]
        return lambda page, node: page.may_have(node, want) and want in page.classes(node)
    if part["attr"]:
        name = part["attr"].lower()
        if part["op"] is None:
            return lambda page, node: name in page.attrs(node)
        want = next((v for v in (part["dq"], part["sq"], part["bare"]) if v is not None), "")
        test = ATTRIBUTE_TESTS[part["op"]]
        return lambda page, node: name in page.attrs(node) and test(page.attrs(node)[name], want)
    if part["pseudo"] == "first-child":
        return lambda page, node: page.siblings()[0][node] < 0
    if part["pseudo"] == "last-child":
        return lambda page, node: page.is_last(node)
    if part["nth"] is not None:
        return _nth(part["nth"])
    inner_tag, inner, stop = _compound(part["inner"].strip(), 0)
    if stop != len(part["inner"].strip()):
        raise ValueError(f"unsupported selector: {part.group()!r}")
    return lambda page, node: not (
        (inner_tag is None or page.tag[node] == inner_tag) and all(check(page, node) for check in inner)
    )


def _nth(formula: str) -> Check:
    parsed = NTH.fullmatch(formula.lower())
    if parsed is None or not formula.strip():
        raise ValueError(f"unsupported selector: nth-child({formula})")
    if parsed["word"]:
        step, offset = 2, int(parsed["word"] == "odd")
    else:
        a = parsed["a"]
        step = 0 if a is None else int(a + "1") if a in ("", "+", "-") else int(a)
        offset = int((parsed["b"] or "0").replace(" ", ""))

    def check(page: Markup, node: int) -> bool:
        distance = page.siblings()[1][node] - offset
        return distance == 0 if step == 0 else distance % step == 0 and distance // step >= 0

    return check
