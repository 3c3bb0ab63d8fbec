"""Orders and top-k reports.  Every order ends with a unique key, so that a limit is repeatable."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def priority(items: DataFrame, marks: Sequence[tuple[Column, int]], score: Column, newest: str, id: str, n: int = 12) -> DataFrame:
    """The n rows with the highest priority of those with any mark: weights of the marks plus the score."""
    total, any_mark = score, F.lit(False)
    for mark, weight in marks:
        mark = F.coalesce(mark, F.lit(False))
        total, any_mark = total + F.when(mark, weight).otherwise(0), any_mark | mark
    ranked = items.where(any_mark).withColumn("priority", total)
    return ranked.orderBy(F.desc("priority"), F.desc_nulls_last(newest), F.asc(id)).limit(n)


def ordered(items: DataFrame, by: str, id: str, due: str = "due", posted: str = "posted", score: str = "score") -> DataFrame:
    """The three orders of the item list: ``score``, ``due`` or ``posted`` first, nulls last."""
    keys = {
        "score": [F.desc_nulls_last(score), F.desc_nulls_last(posted)],
        "due": [F.asc_nulls_last(due), F.desc_nulls_last(score)],
        "posted": [F.desc_nulls_last(posted), F.desc_nulls_last(score)],
    }
    return items.orderBy(*keys[by], F.asc(id))


def by_status(items: DataFrame, status: str, due: str, posted: str, id: str) -> DataFrame:
    """Active before unknown before closed; active by due date, closed by latest due, unknown by newest."""
    rank = F.when(F.col(status) == "active", 0).when(F.col(status) == "unknown", 1).otherwise(2)
    return items.orderBy(
        rank, F.when(rank == 0, F.col(due)).asc_nulls_last(), F.when(rank == 2, F.col(due)).desc_nulls_last(),
        F.when(rank == 1, F.col(posted)).desc_nulls_last(), F.asc(id),
    )


def oldest_checked(items: DataFrame, checked: str, id: str, n: int) -> DataFrame:
    """The next n items to check: never checked ones first, then the longest ago, newest ids first among equals."""
    return items.orderBy(F.col(checked).asc_nulls_first(), F.col(id).desc()).limit(n)
