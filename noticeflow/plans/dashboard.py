"""The dashboard over the item store: derived columns, KPIs, priorities, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms as T
from ..functions.dates import due_soon
from ..operators import aggregates, joins, topk
from .items import ARTICLE, BID, D2B, PLAN

#: Labels of the kinds, and the score from which relevance is high.
KIND_LABELS = {BID: "입찰", PLAN: "발주계획", ARTICLE: "뉴스", "public_agency_contest": "공공주택 공모"}
HIGH = 8.0


def prepared(items: DataFrame, as_of: Column) -> DataFrame:
    """Items with clean numbers, the kind's label and the flags that filters and reports use."""
    label = F
    for kind, shown in KIND_LABELS.items():
        label = label.when(F.col("source_type") == kind, F.lit(shown))
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")))
    named = F.exists(F.array(*map(F.lit, T.COMPETITORS)), lambda n: F.contains(text, n))
    return items.withColumns({
        "relevance_score": F.coalesce(F.col("relevance_score").cast("string").try_cast("double"), F.lit(0.0)),
        "source_type_label": label.otherwise(F.col("source_type")), "is_bid": F.col("source_type") == BID, "is_plan": F.col("source_type") == PLAN,
        "is_news": F.col("source_type") == ARTICLE, "is_due_soon": due_soon("due_at", as_of), "has_competitor_news": (F.col("source_type") == ARTICLE) & named,
    }).withColumn("is_high_relevance", F.col("relevance_score") >= HIGH)


def kpis(items: DataFrame, now: Column) -> DataFrame:
    return aggregates.kpis(items, {
        "new_24h": F.col("created_at") >= now - F.expr("interval 24 hours"), "bid": F.col("is_bid"), "plan": F.col("is_plan"), "news": F.col("is_news"),
        "due_soon": F.col("is_due_soon"), "high_relevance": F.col("is_high_relevance"),
    })


def priorities(items: DataFrame, as_of: Column, n: int = 12) -> DataFrame:
    """The n items to look at first: due, highly relevant, fresh news or defence plans of some relevance, competitors."""
    some = F.col("relevance_score") >= 5
    defence_plan = F.col("is_plan") & (F.col("source_name") == D2B) & some
    fresh_news = F.col("is_news") & (F.to_date("posted_at") >= F.date_sub(as_of, 7)) & some
    marks = [(F.col("is_due_soon"), 20), (F.col("is_high_relevance"), 10), (F.col("has_competitor_news"), 8), (defence_plan, 0), (fresh_news, 0)]
    return topk.priority(items, marks, F.col("relevance_score"), "posted_at", "id", n)


def search_items(items: DataFrame, kind: str | None = None, names: tuple[str, ...] = (), limit: int = 200) -> DataFrame:
    """Items of the API: filtered first, then cut, newest first."""
    out = items.where(F.coalesce(F.col("data_quality"), F.lit("real")) == "real")
    out = out.where(F.col("source_type") == kind) if kind else out
    out = out.where(F.col("source_name").isin(*names)) if names else out
    return topk.ordered(out, "posted", "id", posted="posted_at", score="relevance_score").limit(limit)


def with_details(items: DataFrame, details: DataFrame) -> DataFrame:
    """Items with their newest detail: by item, else by record id and number, else by record id."""
    d = details.select(F.col("item_id").alias("id"), "source_record_id", "source_record_no", "fetched_at", F.col("id").alias("detail_id"), "payload")
    return joins.cascade_lookup(items, d, [["id"], ["source_record_id", "source_record_no"], ["source_record_id"]], ["fetched_at", "detail_id"], ["detail_id", "payload"])


def collector_status(log: DataFrame) -> DataFrame:
    """Per collector: sums of rows, newest run, and success, partial or failed from the set of its states."""
    states = F.collect_set("status")
    status = F.when(F.array_contains(states, "failed") & ~F.array_contains(states, "success"), "failed").when(F.array_contains(states, "failed"), "partial").otherwise("success")
    return log.groupBy("collector_name").agg(
        F.sum("inserted_count").alias("inserted"), F.sum("updated_count").alias("updated"), F.sum("skipped_count").alias("skipped"),
        F.max_by("status", F.struct("started_at", "id")).alias("newest"), F.max("started_at").alias("last_run"), status.alias("status"),
    )
