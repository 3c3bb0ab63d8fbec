"""Registered queries of the engine (without the llm subpackage) and their DuckDB statements."""

from . import boards, dashboard, evaluation, items, merging, nested_records, normalising, probing, records, reports, rules, sections, streams  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
