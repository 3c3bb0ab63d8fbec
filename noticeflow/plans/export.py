"""The cumulative public export: old snapshot and fresh items merged by identity, with lifecycle and guard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dates
from ..functions import terms as T
from ..functions.text import any_term, compact, present
from ..operators import joins, windows
from .items import ARTICLE, PLAN

#: Shares of rows that a snapshot may lose.
BUSINESS_LOSS, NEWS_LOSS = 0.20, 0.30
CONTEST = "public_agency_contest"


def _low(df: DataFrame, c: str) -> Column:
    return F.lower(present(c)) if c in df.columns else F.lit("")


def business_key(df: DataFrame) -> Column:
    """Identity of a business item: contest, plan, tender with its order, or what else is known, as one text."""
    source = F.when(_low(df, "source_name") != "", _low(df, "source_name")).otherwise(_low(df, "source"))
    record = F.coalesce(*[F.nullif(_low(df, c), F.lit("")) for c in ("source_record_id", "bid_no", "plan_no")], F.lit(""))
    kind, day = _low(df, "source_type"), F.substring(_low(df, "posted_at"), 1, 10)
    key = lambda *parts: F.concat_ws("\x1f", *parts)
    return (
        F.when((kind == CONTEST) & (record != ""), key(F.lit("contest"), source, record))
        .when((kind == PLAN) & (_low(df, "plan_no") != ""), key(F.lit("plan"), source, _low(df, "plan_no")))
        .when(_low(df, "bid_no") != "", key(F.lit("bid"), source, _low(df, "bid_no"), _low(df, "bid_order")))
        .when(day != "", key(F.lit("posted"), source, _low(df, "title"), _low(df, "organization"), day))
        .when(_low(df, "id") != "", key(F.lit("id"), _low(df, "id")))
        .otherwise(key(F.lit("due"), source, _low(df, "title"), F.substring(_low(df, "due_at"), 1, 10)))
    )


def news_key(df: DataFrame) -> Column:
    link = F.coalesce(F.nullif(_low(df, "naver_url"), F.lit("")), F.nullif(_low(df, "link"), F.lit("")), F.lit(""))
    media = F.when(_low(df, "media") != "", _low(df, "media")).otherwise(_low(df, "source"))
    return (
        F.when(_low(df, "original_url") != "", F.concat_ws("\x1f", F.lit("url"), _low(df, "original_url")))
        .when(link != "", F.concat_ws("\x1f", F.lit("link"), link))
        .otherwise(F.concat_ws("\x1f", F.lit("title"), _low(df, "title"), media, F.substring(_low(df, "published_at"), 1, 10)))
    )


def included(df: DataFrame, tracked: Column) -> Column:
    """Whether an item is public: contests in an open stage, tracked tenders, and items about modular building."""
    kind, title = F.col("source_type"), F.concat_ws(" ", *[c for c in ("title", "summary", "keywords") if c in df.columns])
    modular = any_term(compact(title), ("모듈러", "osc", "공업화주택", "프리패브", "modular"))
    contest = (kind == CONTEST) & F.coalesce(F.col("notice_status").isin(*T.OPEN_STAGES), F.lit(False)) if "notice_status" in df.columns else kind == CONTEST
    news = (kind == ARTICLE) & modular & (present("original_url") != "")
    return contest | news | (~kind.isin(CONTEST, ARTICLE) & (tracked | modular))


def folded(df: DataFrame, order: str) -> DataFrame:
    """Fresh rows of one key folded in order: of each column the last non-empty value."""
    w = Window.partitionBy("_key").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    columns = [c for c in df.columns if c not in ("_key", order)]
    last = {c: F.last(F.when(joins.nonempty(df, c), F.col(c)), ignorenulls=True).over(w) for c in columns}
    return df.withColumns(last).dropDuplicates(["_key"]).drop(order)


def merge_export(existing: DataFrame, fresh: DataFrame, allowed: DataFrame, kind: str, order: str = "ord") -> DataFrame:
    """The next export: retained old items and fresh ones, merged by identity, with unique ids, newest first.

    ``order`` is the arrival order of both inputs.  Of old items with one identity the last counts;
    fresh ones are folded.  Items named in ``allowed`` (id, reason) with a reason are removed.
    """
    key = business_key if kind == "business" else news_key
    gone = allowed.where(present("reason") != "").select(F.col("id").cast("string").alias("_gone"))
    keep = lambda df: df.join(gone, F.col("id").cast("string") == F.col("_gone"), "left_anti")
    old = keep(existing)
    if kind == "business" and "notice_status" in old.columns:
        old = old.where((F.col("source_type") != CONTEST) | F.coalesce(F.col("notice_status").isin(*T.OPEN_STAGES), F.lit(False)) | F.col("source_type").isNull())
    old = joins.latest(old.withColumn("_key", key(old)), ["_key"], [order]).drop(order)
    new = keep(fresh)
    new = folded(new.withColumn("_key", key(new)), order)
    merged = joins.coalescing_merge(old, new.select(*old.columns), "_key", keep=["id"])
    day = "posted_at" if kind == "business" else "published_at"
    merged = windows.repair_ids(merged, "id", ["_key"])
    return merged.drop("_key").orderBy(F.coalesce(F.col(day).cast("string"), F.lit("")).desc(), F.col("id").desc())


def with_lifecycle(items: DataFrame, now: Column, zone: str = "Asia/Seoul") -> DataFrame:
    """Adds status, days to the deadline, day of closing and the reason."""
    life = dates.lifecycle(F.col("due_at").cast("timestamp"), now, zone)
    out = items.withColumn("_l", life)
    reason = F.when(F.col("_l.status") == "unknown", "no_deadline").when(F.col("_l.status") == "closed", "deadline_passed").otherwise("deadline_today_or_future")
    return out.withColumns({
        "opportunity_status": F.col("_l.status"), "is_closed": F.col("_l.status") == "closed", "days_until_deadline": F.col("_l.days_until"),
        "closed_at": F.col("_l.closed_at"), "lifecycle_reason": reason,
    }).drop("_l")


def guard(business_before: Column, business: Column, news_before: Column, news: Column, allow: bool = False) -> Column:
    """blocked, override, warning or passed, from the row numbers of two snapshots; limits are rounded down."""
    lost = ((business_before > 0) & (business < F.floor(business_before * (1 - BUSINESS_LOSS)))) | ((news_before > 0) & (news < F.floor(news_before * (1 - NEWS_LOSS))))
    fewer = (business < business_before) | (news < news_before)
    return F.when(lost, "override" if allow else "blocked").when(fewer, "warning").otherwise("passed")
