"""Number expressions that give null where a value cannot be read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def amount(c: Column | str) -> Column:
    """Whole number from text with thousands separators and a currency sign; null if it is none."""
    t = F.regexp_replace(F.trim(col(c).cast("string")), r"[,원₩$ ]", "")
    return t.try_cast("double").try_cast("bigint")


def korean_amount(text: Column | str) -> Column:
    """Amount in a text: hundreds of millions before 억, else the number before 원."""
    t = F.regexp_replace(F.coalesce(col(text), F.lit("")), ",", "")
    large, plain = F.regexp_extract(t, r"(\d+(?:\.\d+)?)\s*억\s*원?", 1), F.regexp_extract(t, r"(\d+)\s*원", 1)
    return F.when(large != "", (large.try_cast("double") * 100_000_000).cast("bigint")).when(plain != "", plain.try_cast("bigint"))


def count_before(text: Column | str, unit: str) -> Column:
    """First number with separators before a unit, such as households."""
    return F.regexp_replace(F.regexp_extract(F.coalesce(col(text), F.lit("")), rf"([0-9][0-9,]*)\s*{unit}", 1), ",", "").try_cast("bigint")


def ratio(part: Column, whole: Column, places: int = 4) -> Column:
    """Rounded share; null where there is nothing to divide by."""
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), places)


def whole_number(c: Column | str, default: int = 0) -> Column:
    return F.coalesce(col(c).cast("string").try_cast("bigint"), F.lit(default).cast("bigint"))
