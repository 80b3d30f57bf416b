"""Tables of JSON extraction specs: what is wrong with them, and their rules.

Both run inside each spec's own row; nothing is grouped or shuffled. The JSON
type and the text of every place are looked up once, then the checks are SQL
conditions on those columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import WS
from .gate import HTML_TYPES
from .robots import USER_AGENT
from .rules import DEFAULT_NEXT, MODES, TRANSFORMS

VIOLATION = "struct<path:string,problem:string>"

# How a JSON number may be written inside a string.
FLOAT_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
INT_TEXT = r"^[+-]?[0-9]+$"
# Limits of numbers (least value, whether it is itself allowed, whole numbers only).
LIMITS = {
    "pagination.start_page": (1, True, True),
    "pagination.max_pages": (1, True, True),
    "timeout": (0, False, False),
    "retries": (0, True, True),
    "retry_backoff": (0, True, False),
}
# Settings of a run where a spec gives none.
RETRIES, OUTPUT, ENCODING = 3, "data/result.csv", "utf-8-sig"
BLOCKS = ("item", "pagination", "output")
FLAGS = ("output.deduplicate", "output.append", "respect_robots_txt", "verify_ssl", "stop_on_error")
PLACES = (
    *BLOCKS, *LIMITS, *FLAGS, "start_url", "item.container", "item.fields", "pagination.mode", "pagination.next_selector",
    "pagination.link_selector", "pagination.url_template", "output.path", "output.encoding", "user_agents", "delay",
    "delay.min", "delay.max",
)
FIELD_KEYS = ("selector", "name", "transform", "attribute", "required", "all")


class Place:
    """SQL about one place of the document, given its type and its text."""

    def __init__(self, path: str, prefix: str = "") -> None:
        self.path = path
        self.kind, self.string = (f"{prefix}`{letter}:{path}`" for letter in "ks")
        self.missing = f"{self.kind} is null"
        self.null = f"coalesce({self.kind} = 'VOID', true)"
        self.is_text = f"coalesce({self.kind} = 'STRING', false)"
        self.is_flag = f"coalesce({self.kind} = 'BOOLEAN', false)"
        self.is_object = f"coalesce({self.kind} like 'OBJECT%', false)"
        self.is_list = f"coalesce({self.kind} like 'ARRAY%', false)"
        self.is_number = f"coalesce({self.kind} rlike '^(BIGINT|DECIMAL|DOUBLE)', false)"
        self.text = sql_strip(self.string)
        self.bad_text = f"(not {self.is_text} or {self.text} = '')"
        self.bad_flag = f"(not {self.null} and not {self.is_flag})"
        # Neither null, false, zero, nor empty.
        self.truthy = f"(not {self.null} and not coalesce({self.string} in ('', 'false', '0', '0.0', '[]', '{{}}'), false))"

    def number(self, pattern: str = FLOAT_TEXT) -> str:
        """The number, also from a string or a flag; null if it is none."""
        plain = f"when {self.is_text} and {self.text} rlike r'{pattern}' then try_cast({self.text} as double)"
        flag = f"when {self.is_flag} then if({self.string} = 'true', 1d, 0d)"
        return f"(case when {self.is_number} then try_cast({self.string} as double) {plain} {flag} end)"

    def check(self, bad: str, problem: str) -> str:
        return f"case when {bad} then named_struct('path', '{self.path}', 'problem', '{problem}') end"


def sql_strip(text: str) -> str:
    return rf"regexp_replace({text}, r'\A[{WS}]+|[{WS}]+\z', '')"


def looked_up(document: str, path: str, name: str | None = None) -> list[str]:
    """SQL for the type and the text of a place."""
    name = path if name is None else name
    return [
        f"schema_of_variant(try_variant_get({document}, '$.{path}', 'variant')) as `k:{name}`",
        f"try_variant_get({document}, '$.{path}', 'string') as `s:{name}`",
    ]


def derived_name(selector: str) -> str:
    """SQL: a column name from the last two words of a selector; null if it has none."""
    words = rf"filter(split(regexp_replace({selector}, r'[^\p{{L}}\p{{N}} _-]', ' '), ' +'), word -> word <> '')"
    last = "transform(slice(words, greatest(size(words) - 1, 1), 2), word -> regexp_replace(word, '^-+|-+$', ''))"
    joined = f"array_join({last}, '_')"
    name = f"case when size(words) > 0 then if({joined} <> '', {joined}, element_at(words, -1)) end"
    return f"transform(array({words}), words -> {name})[0]"


def field_name(selector: Place, name: Place) -> str:
    given = f"when {name.truthy} then if({name.bad_text}, null, {name.text})"
    return f"case {given} when not {selector.bad_text} then {derived_name(selector.text)} end"


def _fields(specs: DataFrame) -> DataFrame:
    """``spec`` as a variant and ``fields``: type and text of each rule's keys, with its name."""
    parsed = specs.selectExpr("spec_id", "try_parse_json(spec_json) as spec")
    keys = ", ".join(f"{looked}" for key in FIELD_KEYS for looked in looked_up("f", key))
    listed = f"transform(try_variant_get(spec, '$.item.fields', 'array<variant>'), f -> struct(f, schema_of_variant(f) as kind, {keys}))"
    parsed = parsed.selectExpr("*", f"{listed} as listed")
    name = field_name(Place("selector", "r."), Place("name", "r."))
    return parsed.selectExpr("*", f"transform(listed, r -> {name}) as names")


def spec_lint(specs: DataFrame) -> DataFrame:
    """``spec_id, spec_json`` → every ``(spec_id, path, problem)``."""
    rows = _fields(specs).selectExpr(
        "*",
        "try_variant_get(spec, '$.user_agents', 'array<variant>') as agents",
        *(looked for path in PLACES for looked in looked_up("spec", path)),
    )
    checks = [*_root_checks(), *_item_checks(), *_pager_checks(), *_output_checks(), *_fetch_checks()]
    in_fields = f"flatten(transform(listed, (r, i) -> array({', '.join(_field_checks())})))"
    repeated = """transform(
        filter(array_distinct(names), name -> name is not null and size(filter(names, other -> other = name)) > 1),
        name -> named_struct('path', 'item.fields', 'problem', concat('repeated name: ', name)))"""
    none = f"cast(array() as array<{VIOLATION}>)"
    found = f"filter(concat(array({', '.join(checks)}), coalesce({in_fields}, {none}), coalesce({repeated}, {none})), v -> v is not null)"
    not_object = "array(named_struct('path', '', 'problem', 'the document is not an object'))"
    whole = "coalesce(schema_of_variant(spec) like 'OBJECT%', false)"
    problems = rows.select("spec_id", F.explode(F.expr(f"if({whole}, {found}, {not_object})")).alias("v"))
    return problems.select("spec_id", "v.path", "v.problem")


def _first(*checks: str) -> str:
    return f"coalesce({', '.join(checks)})"


def _inside(condition: str, checks: list[str]) -> list[str]:
    return [f"if({condition}, {check}, null)" for check in checks]


def _number_check(path: str, least: float, may_equal: bool, whole: bool) -> str:
    place = Place(path)
    value = place.number(INT_TEXT if whole else FLOAT_TEXT)
    rounded = f"(sign({value}) * floor(abs({value})))" if whole else value
    low = f"{rounded} {'<' if may_equal else '<='} {least}"
    return _first(
        place.check(f"not {place.missing} and {value} is null", f"expected a {'whole ' if whole else ''}number"),
        place.check(low, f"must be {'>=' if may_equal else '>'} {least}"),
    )


def _optional_text(path: str, null_allowed: bool) -> str:
    place = Place(path)
    absent = place.null if null_allowed else place.missing
    return place.check(f"not {absent} and {place.bad_text}", "expected a text")


def _block_check(path: str) -> str:
    place = Place(path)
    return place.check(f"not {place.null} and not {place.is_object}", "expected an object")


def _flag_check(path: str) -> str:
    return Place(path).check(Place(path).bad_flag, "expected true or false")


def _root_checks() -> list[str]:
    url = Place("start_url")
    return [
        _first(
            url.check(url.missing, "missing"),
            url.check(url.bad_text, "expected a text"),
            url.check(f"not {url.text} rlike '^https?://'", "must start with http:// or https://"),
        )
    ]


def _item_checks() -> list[str]:
    item, container, fields = Place("item"), Place("item.container"), Place("item.fields")
    inner = [
        container.check(container.bad_text, "expected a text"),
        fields.check(f"not {fields.is_list} or coalesce(size(listed) = 0, true)", "expected a list of rules"),
    ]
    return [item.check(item.null, "missing"), _block_check("item"), *_inside(item.is_object, inner)]


def _field_checks() -> list[str]:
    """Checks of rule ``r``, the ``i``-th of its spec."""
    selector, name, transform, attribute, required, every = (Place(key, "r.") for key in FIELD_KEYS)
    known = ", ".join(f"'{t}'" for t in TRANSFORMS)
    checks = [
        ("selector", selector.missing, "missing"),
        ("selector", f"not {selector.missing} and {selector.bad_text}", "expected a text"),
        ("name", f"{name.truthy} and {name.bad_text}", "expected a text"),
        ("name", f"not {name.truthy} and not {selector.bad_text} and names[i] is null", "no name in the selector"),
        ("transform", f"not {transform.missing} and not coalesce({transform.string} in ({known}), false)", "unknown transform"),
        ("attribute", f"not {attribute.null} and {attribute.bad_text}", "expected a text"),
        ("required", required.bad_flag, "expected true or false"),
        ("all", every.bad_flag, "expected true or false"),
    ]
    is_rule = "coalesce(r.kind like 'OBJECT%', false)"
    wrong = [
        f"case when {is_rule} and {bad} then named_struct('path', concat('item.fields[', i, '].{key}'), 'problem', '{problem}') end"
        for key, bad, problem in checks
    ]
    no_rule = f"case when not {is_rule} then named_struct('path', concat('item.fields[', i, ']'), 'problem', 'expected an object') end"
    return [no_rule, *wrong]


def _pager_checks() -> list[str]:
    block, mode, template = Place("pagination"), Place("pagination.mode"), Place("pagination.url_template")
    following, links = Place("pagination.next_selector"), Place("pagination.link_selector")
    names = ", ".join(f"'{m}'" for m in MODES)
    known = f"({mode.is_text} and {mode.string} in ({names}))"
    active = f"(case when {mode.missing} then 'next' when {known} then {mode.string} end)"
    usable = f"(not {template.null} and not {template.bad_text})"
    placed = f"contains({template.string}, '{{page}}')"
    # Braces other than {page} have no meaning in a template.
    braces = rf"regexp_replace({template.string}, r'\{{page\}}', '') rlike '[{{}}]'"
    checks = [
        mode.check(f"not {mode.missing} and not {known}", "unknown mode"),
        *(_optional_text(place.path, null_allowed=True) for place in (following, links, template)),
        template.check(f"{usable} and not {placed}", "lacks {page}"),
        template.check(f"{usable} and {placed} and {braces}", "braces other than {page}"),
        following.check(f"{active} = 'next' and not {following.missing} and {following.null}", "needed for mode next"),
        links.check(f"{active} = 'links' and {links.null}", "needed for mode links"),
        template.check(f"{active} = 'template' and {template.null}", "needed for mode template"),
        *(_number_check(path, *limits) for path, limits in LIMITS.items() if path.startswith("pagination.")),
    ]
    return [_block_check("pagination"), *_inside(f"{block.null} or {block.is_object}", checks)]


def _output_checks() -> list[str]:
    checks = [_optional_text(path, null_allowed=False) for path in ("output.path", "output.encoding")]
    return [_block_check("output"), *checks, *(_flag_check(path) for path in FLAGS if path.startswith("output."))]


def _fetch_checks() -> list[str]:
    agents, delay, low, high = (Place(path) for path in ("user_agents", "delay", "delay.min", "delay.max"))
    blank = f"""exists(agents, a -> schema_of_variant(a) <> 'STRING'
        or {sql_strip("try_variant_get(a, '$', 'string')")} = '')"""
    usable = f"({agents.is_text} and {agents.text} <> '') or ({agents.is_list} and size(agents) > 0 and not {blank})"
    # Bounds used where a spec gives none.
    least, most = f"if({low.missing}, 1d, {low.number()})", f"if({high.missing}, 3d, {high.number()})"
    plain = f"({delay.is_number} or {delay.is_flag})"
    parts = [
        _number_check("delay.min", 0, True, False),
        _number_check("delay.max", 0, True, False),
        low.check(f"{least} > {most}", "is above delay.max"),
    ]
    return [
        agents.check(f"not {agents.null} and not coalesce({usable}, false)", "expected a list of texts"),
        delay.check(f"{delay.truthy} and not {plain} and not {delay.is_object}", "expected a number or an object"),
        low.check(f"{plain} and {delay.number()} < 0", "must be >= 0"),
        *_inside(delay.is_object, parts),
        *(_number_check(path, *limits) for path, limits in LIMITS.items() if not path.startswith("pagination.")),
        *(_flag_check(path) for path in FLAGS if not path.startswith("output.")),
    ]


def spec_fields(specs: DataFrame) -> DataFrame:
    """One row per field rule with its defaults filled in."""
    zipped = F.arrays_zip(F.col("listed.f").alias("field"), F.col("names").alias("name"))
    rows = _fields(specs).select("spec_id", F.posexplode(zipped).alias("field_no", "rule"))

    def value(key: str, kind: str = "string") -> str:
        return f"try_variant_get(rule.field, '$.{key}', '{kind}')"

    return rows.selectExpr(
        "spec_id",
        "field_no",
        "rule.name",
        f"{sql_strip(value('selector'))} as selector",
        f"{sql_strip(value('attribute'))} as attribute",
        f"coalesce({value('transform')}, 'text') as transform",
        f"coalesce({value('required', 'boolean')}, false) as required",
        f"coalesce({value('all', 'boolean')}, false) as collect_all",
        f"coalesce({value('join_with')}, ' ') as join_with",
    )


def spec_crawls(specs: DataFrame) -> DataFrame:
    """The crawl of each spec with its defaults filled in: walk, gate and output settings."""

    def value(path: str, kind: str = "string") -> str:
        return f"try_variant_get(spec, '$.{path}', '{kind}')"

    def texts(path: str, default: tuple[str, ...]) -> str:
        """A list of texts, or one text for a list of one; without any, the default."""
        listed = f"filter(transform({value(path, 'array<string>')}, t -> {sql_strip('t')}), t -> t <> '')"
        single = f"case when schema_of_variant({value(path, 'variant')}) = 'STRING' then array({sql_strip(value(path))}) end"
        given = f"case when size({listed}) > 0 then {listed} end"
        names = ", ".join(f"'{name}'" for name in default)
        return f"coalesce({given}, {single}, array({names}))"

    return specs.selectExpr("spec_id", "try_parse_json(spec_json) as spec").selectExpr(
        "spec_id as crawl_id",
        f"{sql_strip(value('start_url'))} as start_url",
        f"coalesce({value('pagination.mode')}, 'next') as mode",
        f"coalesce({value('pagination.next_selector')}, '{DEFAULT_NEXT}') as next_selector",
        f"{value('pagination.link_selector')} as link_selector",
        f"{value('pagination.url_template')} as url_template",
        f"coalesce({value('pagination.start_page', 'long')}, 1) as start_page",
        f"coalesce({value('pagination.max_pages', 'long')}, 10) as max_pages",
        f"coalesce({value('stop_on_error', 'boolean')}, true) as stop_on_error",
        f"{sql_strip(value('item.container'))} as container",
        f"coalesce({value('retries', 'long')}, {RETRIES}) as retries",
        f"{texts('allowed_content_types', HTML_TYPES)} as content_types",
        f"{texts('user_agents', (USER_AGENT,))}[0] as user_agent",
        f"coalesce({value('respect_robots_txt', 'boolean')}, true) as respect_robots",
        f"coalesce({sql_strip(value('output.path'))}, '{OUTPUT}') as output_path",
        f"coalesce({value('output.encoding')}, '{ENCODING}') as output_encoding",
        f"coalesce({value('output.deduplicate', 'boolean')}, true) as deduplicate",
        f"coalesce({value('output.append', 'boolean')}, false) as append",
    )
