"""Aggregates of the dashboard, the scan profiles and the review reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import ratio


def kpis(items: DataFrame, counts: Mapping[str, Column]) -> DataFrame:
    """One row: ``total`` and the number of rows for which each condition holds, in one pass."""
    return items.agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in counts.items()]
    )


def top_counts(items: DataFrame, key: str, n: int | None = None, name: str = "n") -> DataFrame:
    """Counts by key, largest first, the key settles ties; at most n rows."""
    out = items.groupBy(key).agg(F.count(F.lit(1)).alias(name)).orderBy(F.desc(name), F.asc_nulls_last(key))
    return out.limit(n) if n else out


def daily_trend(items: DataFrame, time: str, as_of: Column, days: int) -> DataFrame:
    """Rows per day of the last days, today included; days without rows are left out."""
    day = F.to_date(time)
    inside = (day > F.date_sub(as_of, days)) & (day <= as_of)
    return items.where(inside).groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"))


def histogram(items: DataFrame, value: str, edges: Sequence[tuple[str, float, float]]) -> DataFrame:
    """Rows per bucket (label, above, up to and including); empty buckets stay, values outside go.

    One pass with one conditional count per bucket, then turned into rows: nothing is shuffled but
    the partial counts, and the bucket table needs no join.
    """
    v = F.col(value)
    counts = [F.count_if((v > low) & (v <= high)).alias(f"b{i}") for i, (_, low, high) in enumerate(edges)]
    rows = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(label).alias("bucket"), F.col(f"b{i}").alias("n")) for i, (label, _, _) in enumerate(edges)])
    return items.agg(*counts).select(F.explode(rows).alias("r")).select("r.*")


def token_counts(items: DataFrame, text: Column, separator: str, n: int) -> DataFrame:
    """The n most frequent trimmed tokens of a separated text; the token settles ties."""
    tokens = items.select(F.explode(F.split(F.coalesce(text, F.lit("")), separator)).alias("token"))
    tokens = tokens.select(F.trim("token").alias("token")).where("token <> ''")
    return top_counts(tokens, "token", n)


def distribution(items: DataFrame, key: str, skew: float = 0.7) -> DataFrame:
    """Count, share of all rows (4 places) and whether the share marks a skew, by key."""
    counted = items.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    share = ratio(F.col("n"), F.sum("n").over(Window.partitionBy()))
    return counted.withColumn("share", share).withColumn("skewed", F.col("share") >= skew)


def exploded_counts(items: DataFrame, values: str, name: str) -> DataFrame:
    """Count of each value of an array column, largest first, the value settles ties."""
    return top_counts(items.select(F.explode(values).alias(name)), name)


def duplicate_counts(items: DataFrame, keys: Mapping[str, Column]) -> DataFrame:
    """One row: for each key, rows beyond the first with that key; rows without the key do not count.

    Each key is counted by a grouping of its own that combines before it shuffles.
    """
    marks = F.array(*[F.struct(F.lit(n).alias("kind"), k.cast("string").alias("key")) for n, k in keys.items()])
    per_key = items.select(F.explode(marks).alias("m")).select("m.*").where("key is not null").groupBy("kind", "key").count()
    extra = per_key.groupBy().agg(*[
        F.coalesce(F.sum(F.when(F.col("kind") == n, F.col("count") - 1)), F.lit(0)).alias(n) for n in keys
    ])
    return extra


def keys_in_several(items: DataFrame, key: str, group: str) -> DataFrame:
    """Keys that stand in two groups or more: (key, groups, rows)."""
    pairs = items.where(F.col(key).isNotNull()).groupBy(key, group).agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy(key).agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("rows")).where("groups >= 2")


def conserved(totals: DataFrame, identities: Mapping[str, Column]) -> DataFrame:
    """Adds a boolean per identity that the counts must satisfy, and ``all_hold``."""
    out = totals.select("*", *[F.coalesce(c, F.lit(False)).alias(n) for n, c in identities.items()])
    both = F.lit(True)
    for n in identities:
        both = both & F.col(n)
    return out.withColumn("all_hold", both)


def classifier_quality(rows: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """One row of counts, precision of both classes, recall and coverage; unlabelled rows have null ``actual``."""
    tp, fp = F.count_if(predicted & actual), F.count_if(predicted & ~actual)
    tn, fn = F.count_if(~predicted & ~actual), F.count_if(~predicted & actual)
    return rows.agg(
        F.count(F.lit(1)).alias("rows"), F.count(actual).alias("labelled"),
        tp.alias("true_positive"), fp.alias("false_positive"), tn.alias("true_negative"), fn.alias("false_negative"),
    ).select(
        "*",
        ratio(F.col("true_positive"), F.col("true_positive") + F.col("false_positive")).alias("precision_relevant"),
        ratio(F.col("true_negative"), F.col("true_negative") + F.col("false_negative")).alias("precision_irrelevant"),
        ratio(F.col("true_positive"), F.col("true_positive") + F.col("false_negative")).alias("recall_relevant"),
        ratio(F.col("labelled"), F.col("rows")).alias("coverage"),
    )


def facets(items: DataFrame, columns: Sequence[str], day: str) -> DataFrame:
    """One row for filter controls: sorted distinct values of each column, first and last day."""
    return items.agg(
        *[F.array_sort(F.collect_set(c)).alias(c) for c in columns],
        F.min(F.to_date(day)).alias("first_day"), F.max(F.to_date(day)).alias("last_day"),
    )


def scan_profile(rows: DataFrame, valid: Column, stamp: Column, batch: Column) -> DataFrame:
    """One row about a scan: rows, valid ones, stamps present, parsed and against the batch time."""
    from ..functions.dates import article_time

    at, there = article_time(stamp), F.trim(F.coalesce(stamp, F.lit(""))) != ""
    return rows.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(valid).alias("valid"), F.count_if(there).alias("stamp_present"),
        F.count(at).alias("stamp_parsed"), F.count_if(~there).alias("stamp_missing"), F.count_if(there & at.isNull()).alias("stamp_invalid"),
        F.min(at).alias("first_stamp"), F.max(at).alias("last_stamp"),
        F.count_if(at < batch).alias("before_batch"), F.count_if(at == batch).alias("at_batch"), F.count_if(at > batch).alias("after_batch"),
    )


def shrink_guard(now: Column, before: Column, share: float) -> Column:
    """Whether a snapshot lost more than a share of its rows; the limit is rounded down."""
    return now < F.floor(before * (1 - share))


def newest_status(log: DataFrame, key: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Newest log row per key and how often each key ran and failed."""
    newest = F.max_by(F.struct(*columns), F.struct(*order)).alias("newest")
    return log.groupBy(key).agg(newest, F.count(F.lit(1)).alias("runs")).select(key, "newest.*", "runs")


def reconciled(df: DataFrame, key: str, published: Column) -> DataFrame:
    """Per key: rows stored, rows published, and the decision between all, most, some and none filtered.

    A ``published`` that is null is not published.
    """
    p, s = F.col("published"), F.col("stored")
    per = df.groupBy(key).agg(F.count(F.lit(1)).alias("stored"), F.count_if(F.coalesce(published, F.lit(False))).alias("published"))
    decision = F.when(p == 0, "all_filtered").when(p < s / 2, "mostly_filtered").when(p < s, "some_filtered").otherwise("complete")
    return per.withColumn("decision", decision)
