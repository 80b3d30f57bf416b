"""What to take from a page: plan-time parameters of the extraction job."""

from __future__ import annotations

from dataclasses import dataclass

# Names of the transforms and walk modes, default pager selector.
TRANSFORMS = ("text", "strip", "price", "url", "int", "float")
MODES = ("next", "links", "template", "none")
DEFAULT_NEXT = "a.next, .pagination a[rel=next]"


@dataclass(frozen=True)
class FieldRule:
    """One output column of a card."""

    name: str
    selector: str
    attribute: str | None = None
    transform: str = "text"
    required: bool = False
    collect_all: bool = False
    join_with: str = " "

    def __post_init__(self) -> None:
        if self.transform not in TRANSFORMS:
            raise ValueError(f"{self.name}: unknown transform {self.transform!r}")


@dataclass(frozen=True)
class PageRules:
    """Which elements are cards, and their columns in output order."""

    container: str
    fields: tuple[FieldRule, ...]

    def __post_init__(self) -> None:
        if not self.fields:
            raise ValueError("at least one field rule is needed")
        if len(set(self.names)) != len(self.fields):
            raise ValueError(f"field names repeat: {self.names}")

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    @property
    def required(self) -> list[str]:
        return [f.name for f in self.fields if f.required]


@dataclass(frozen=True)
class PagerRules:
    """Where a page links to the pages after it."""

    next_selector: str | None = DEFAULT_NEXT
    link_selector: str | None = None
