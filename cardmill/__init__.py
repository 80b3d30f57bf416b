"""Records from tables of stored web pages, as Spark jobs."""

from .operators.rules import FieldRule, PageRules, PagerRules
from .session import build_session

__all__ = ("FieldRule", "PageRules", "PagerRules", "build_session")
