"""Sections of the dashboard and the filters that its pages add, and limits in the order they apply."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, contains_text

# Kinds of items by section, and words of calls for research projects.
SECTION_KINDS = {"bid": ("bid", "입찰/조달"), "news": ("news", "뉴스"), "patent": ("patent",)}
CALL_WORDS = ("공고", "지원", "사업")
#: The order of classes of candidates; others come last.
LAST_CLASS = 99


def _text(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


def in_section(name: str) -> Column:
    """Whether an item belongs to a section; an unknown section has no items."""
    if name in SECTION_KINDS:
        return F.coalesce(F.col("source_type").isin(*SECTION_KINDS[name]), F.lit(False))
    call = F.lit(False)
    for w in CALL_WORDS:
        call = call | F.contains(_text("summary"), F.lit(w))
    research = F.coalesce(F.col("source_type") == "rnd", F.lit(False))
    return {"rnd-announce": research & call, "rnd-outcome": research & ~call}.get(name, F.lit(False))


def refined(items: DataFrame, section: str, include: str = "", exclude: str = "", ipc: str = "", open_from: Column | None = None) -> DataFrame:
    """The settings a section's page adds: open tenders only, words of news to have or not, a patent class."""
    if section == "bid" and open_from is not None:
        items = items.where(F.col("due_at").isNotNull() & (F.col("due_at") >= open_from))
    if section == "news":
        text = F.concat_ws(" ", _text("title"), _text("summary"))
        if include.strip():
            items = items.where(contains_text(text, include.strip()))
        if exclude.strip():
            items = items.where(~contains_text(text, exclude.strip()))
    if section == "patent" and ipc.strip():
        items = items.where(contains_text(F.concat_ws(" ", _text("keywords"), _text("summary")), ipc.strip()))
    return items


def modular(title: Column | str, goods_only: bool = False) -> Column:
    """Whether the title without spaces names modular building; goods only: of goods tenders of the state portal."""
    named = F.contains(F.replace(F.lower(_text(title)), F.lit(" "), F.lit("")), F.lit("모듈러"))
    return named & F.coalesce((F.col("source_name") == "나라장터") & (F.col("business_type") == "물품"), F.lit(False)) if goods_only else named


def announcements(items: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    """Of the first 2 * limit research items in order, the first ``limit`` that are calls: limit, filter, limit."""
    first = items.where(F.col("source_type") == "rnd").orderBy(*order).limit(2 * limit)
    text = F.when(_text("summary") != "", _text("summary")).otherwise(_text("title"))
    return first.where(F.contains(text, F.lit(CALL_WORDS[0]))).orderBy(*order).limit(limit)


def business_page(kind: str = "all", agency: str = "all", status: str = "all", search: str = "", searched: Sequence[str] = ("title",)) -> Column:
    """The business page's filter: kind, agency and lifecycle status, each "all" or exact, and a search text."""
    out = F.lit(True)
    for c, wanted in (("source_type", kind), ("agency", agency), ("status", status)):
        if wanted != "all":
            out = out & F.coalesce(F.col(c) == wanted, F.lit(False))
    return out & contains_text(F.concat_ws(" ", *map(_text, searched)), search.strip()) if search.strip() else out


def news_page(source: str | None = None, days: int | None = None, now: Column | None = None, search: str = "") -> Column:
    """The news page's filter: medium or source, published within some days (unknown times fall out), search text."""
    out = F.lit(True)
    if source is not None:
        out = out & (F.coalesce(F.col("media") == source, F.lit(False)) | F.coalesce(F.col("source") == source, F.lit(False)))
    if days is not None:
        out = out & F.coalesce(F.col("published_at") >= now - F.make_dt_interval(F.lit(days)), F.lit(False))
    return out & contains_text(F.concat_ws(" ", *map(_text, ("title", "media", "source", "summary"))), search) if search else out


def by_class(items: DataFrame, classes: Sequence[str], kind: str, published: str, *ties: str) -> DataFrame:
    """Candidates by class, then time (unknown last), then the given texts."""
    rank = F
    for n, c in enumerate(classes):
        rank = rank.when(F.trim(_text(kind)) == c, n)
    return items.orderBy(rank.otherwise(LAST_CLASS), F.asc_nulls_last(published), *[F.trim(_text(t)) for t in ties])


def amount_shown(c: Column | str) -> Column:
    """An amount for display: - without one or for zero, hundreds of millions with a decimal, else in full."""
    n = col(c).cast("double").cast("bigint")
    # one decimal of the very double, as formats of other languages have it: its fraction is a whole number of 1 / 2 ** 52
    units, half = n / F.lit(1e8), 1 << 51
    whole = F.floor(units)
    tenths = ((units - whole) * F.lit(float(1 << 52))).cast("bigint") * 10
    down, rest = F.shiftright(tenths, 52), tenths.bitwiseAND((1 << 52) - 1)
    up = F.when((rest > half) | ((rest == half) & (down % 2 == 1)), 1).otherwise(0)
    digit = down + up
    large = F.concat((whole + F.when(digit == 10, 1).otherwise(0)).cast("string"), F.lit("."), (digit % 10).cast("string"), F.lit("억 원"))
    return F.when(n.isNull() | (n == 0), "-").when(n >= 100_000_000, large).otherwise(F.concat(F.format_number(n, 0), F.lit("원")))


def joined_values(values: Column) -> Column:
    """The values of an array for a CSV field, separated by semicolons; records as JSON."""
    return F.array_join(values if isinstance(values, Column) else F.col(values), ";")
