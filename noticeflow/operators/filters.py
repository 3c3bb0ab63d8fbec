"""Composite filters over item tables.  Every predicate is optional; Catalyst combines them into one filter."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_text


@dataclass(frozen=True)
class ItemFilter:
    """What to keep.  Empty settings keep everything.

    ``one_of``: column -> accepted values.  ``one_of_or_blank``: the same, null and '' pass too.
    ``at_least``: column -> number, only above zero.  ``flags``: boolean columns that must hold.
    ``without``: column -> texts that must not stand in it (null counts as '').
    ``containing``: column -> text that must stand in it, ignoring case, no pattern.
    ``between``: column -> (first, last) day, either may be None; null dates are left out.
    ``search``: text looked for in the space-joined ``search_columns``, so it may span two of them.
    """

    one_of: Mapping[str, Iterable] = field(default_factory=dict)
    one_of_or_blank: Mapping[str, Iterable] = field(default_factory=dict)
    at_least: Mapping[str, float] = field(default_factory=dict)
    flags: Iterable[str] = ()
    without: Mapping[str, Iterable[str]] = field(default_factory=dict)
    containing: Mapping[str, str] = field(default_factory=dict)
    between: Mapping[str, tuple[date | None, date | None]] = field(default_factory=dict)
    search: str = ""
    search_columns: Iterable[str] = ()

    def predicate(self) -> Column:
        out = F.lit(True)
        for c, values in self.one_of.items():
            if values := list(values):
                out = out & F.col(c).isin(values)
        for c, values in self.one_of_or_blank.items():
            if values := list(values):
                out = out & (F.col(c).isNull() | (F.col(c) == "") | F.col(c).isin(values))
        for c, least in self.at_least.items():
            if least > 0:
                out = out & (F.col(c) >= least)
        for c in self.flags:
            out = out & F.col(c)
        for c, texts in self.without.items():
            for t in texts:
                out = out & ~F.contains(F.coalesce(F.col(c), F.lit("")), F.lit(t))
        for c, t in self.containing.items():
            if t:
                out = out & contains_text(c, t)
        for c, (first, last) in self.between.items():
            if first is not None:
                out = out & (F.to_date(c) >= F.lit(first))
            if last is not None:
                out = out & (F.to_date(c) <= F.lit(last))
        if self.search.strip():
            joined = F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in self.search_columns])
            out = out & contains_text(joined, self.search.strip())
        return out


def filter_items(items: DataFrame, wanted: ItemFilter) -> DataFrame:
    return items.where(wanted.predicate())


def scoped(items: DataFrame, in_scope: Column, restricted: Column, tracked: DataFrame, key: str) -> DataFrame:
    """Rows outside the restricted source, rows in scope, and tracked rows whatever their scope, each once."""
    known = tracked.select(F.col(key).alias("_tracked")).distinct()
    marked = items.join(known, F.col(key) == F.col("_tracked"), "left")
    return marked.where(~restricted | F.coalesce(in_scope, F.lit(False)) | F.col("_tracked").isNotNull()).drop("_tracked")


def delete_where(items: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is not true; an unknown condition keeps the row."""
    return items.where(~F.coalesce(condition, F.lit(False)))


def update_where(items: DataFrame, condition: Column, values: Mapping[str, Column]) -> DataFrame:
    """Sets columns where the condition is true."""
    hit = F.coalesce(condition, F.lit(False))
    return items.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def violations(rules: Mapping[str, Column]) -> Column:
    """Array of the names of the rules that a row breaks."""
    return F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in rules.items()]))


def since(c: Column | str, cutoff: Column) -> Column:
    """Whether a date lies at or after ``cutoff``; dates that are missing pass."""
    day = F.to_date(c)
    return day.isNull() | F.coalesce(day >= cutoff, F.lit(True))
