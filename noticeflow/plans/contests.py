"""Public summary of contest sources: items and their links, the last run, and what its log counted, summed over sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# States of a run that count as a success.
GOOD = ("success", "partial_warning")
COUNTS = "map<string,bigint>"


def contest_summary(items: DataFrame, logs: DataFrame) -> DataFrame:
    """Per source of items or logs: items, exact links, status, last_attempt, last_success, note and ``stats``.

    ``items`` has source and link (null or empty: none); ``logs`` source, log_id, started_at, finished_at, status and message, a
    JSON object of figures or a text.  The newest log counts, by start and then id.  ``stats`` are the whole numbers
    at the top of the object by key; a message that is no object is the ``note``.  Null sources
    are one source.
    """
    own = items.groupBy("source").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.coalesce("link", F.lit("")) != "").alias("exact"))
    last = logs.groupBy("source").agg(F.max(F.struct("started_at", "log_id", "finished_at", "status", "message")).alias("m"))
    both = own.withColumnRenamed("source", "_source").join(last, F.col("_source").eqNullSafe(F.col("source")), "full")
    none, m = F.create_map().cast(COUNTS), F.col("m")
    parsed = F.when(F.startswith(F.trim("m.message"), F.lit("{")), F.from_json("m.message", "map<string,string>"))
    figures = F.map_filter(F.transform_values(parsed, lambda k, v: v.try_cast("bigint")), lambda k, v: v.isNotNull())
    count, good = F.coalesce("items", F.lit(0).cast("bigint")), F.coalesce(m["status"].isin(*GOOD), F.lit(False))
    status = (
        F.when(m.isNull(), F.when(count == 0, "not_collected").otherwise("previous_data_retained"))
        .when(good, F.when(count > 0, "success").otherwise("success_no_public_match")).otherwise("failed")
    )
    return both.select(
        F.coalesce("_source", "source").alias("source"), count.alias("items"), F.coalesce("exact", F.lit(0).cast("bigint")).alias("exact"), status.alias("status"),
        m["started_at"].alias("last_attempt"), F.when(good, m["finished_at"]).alias("last_success"), F.when(parsed.isNull(), m["message"]).alias("note"),
        F.coalesce(figures, none).alias("stats"),
    )


def summed_stats(summary: DataFrame) -> DataFrame:
    """One row: sources, items, exact links, sources by status, and the sums of all ``stats`` by key, as maps.

    Keys are summed as rows, so that any number of sources adds up in parallel; only the distinct keys meet in a row.
    """
    keys = summary.select(F.explode("stats").alias("key", "n")).groupBy("key").agg(F.sum("n").alias("n"))
    stats = keys.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "n")))).alias("stats"))
    states = summary.groupBy("status").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("states"))
    totals = summary.agg(F.count(F.lit(1)).alias("sources"), F.coalesce(F.sum("items"), F.lit(0)).alias("items"), F.coalesce(F.sum("exact"), F.lit(0)).alias("exact"))
    return totals.join(states).join(stats)
