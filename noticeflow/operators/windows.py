"""Ordered and grouped idioms: id repair, quotas, runs of errors, provider states, ranked choices."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Scratch


def numbered_in_order(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Adds the running number of each row in order, from 1, without gathering the rows in one task.

    Rows are dealt to partitions by ranges of the order and sorted there; a row's number is its place
    in its partition plus the rows of the partitions before, of which there is one count each.
    """
    mark, start = f"_{name}_mark", f"_{name}_start"
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(mark, F.monotonically_increasing_id())
    placed = Scratch(rows.sparkSession, "numbered").keep(placed, "placed")
    counts = placed.groupBy(F.shiftright(mark, 33).alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row per partition
    counts = counts.select("_part", F.coalesce(before, F.lit(0)).alias(start))
    out = placed.join(F.broadcast(counts), F.shiftright(mark, 33) == F.col("_part"))
    return out.withColumn(name, F.col(start) + F.col(mark).bitwiseAND((1 << 33) - 1) + 1).select(*rows.columns, name)


def repair_ids(rows: DataFrame, id: str, order: Sequence[str]) -> DataFrame:
    """Text ids for all rows: the first row keeps a given id, missing and repeated ids are numbered on.

    New numbers go on from the largest numeric id, in order.  Only the rows in need of a number are
    numbered; the first row of each id is found per id, by a minimum that combines before it shuffles.
    """
    given = F.when(F.trim(F.coalesce(F.col(id).cast("string"), F.lit(""))) != "", F.trim(F.col(id).cast("string")))
    marked = Scratch(rows.sparkSession, "ids").keep(rows.withColumn("_given", given).withColumn("_row", F.monotonically_increasing_id()), "given")
    firsts = marked.where("_given is not null").groupBy("_given").agg(F.min(F.struct(*order, "_row")).alias("_best"))
    firsts = firsts.select(F.col("_best._row").alias("_row"), F.lit(True).alias("_good"))
    marked = marked.join(firsts, "_row", "left")
    top = marked.agg(F.coalesce(F.max(F.col("_given").try_cast("bigint")), F.lit(0)).alias("_top"))
    bad = numbered_in_order(marked.where("_good is null").select(*rows.columns), order, "_n")
    bad = bad.join(F.broadcast(top)).withColumn(id, (F.col("_top") + F.col("_n")).cast("string"))  # top is one row
    good = marked.where("_good").withColumn(id, F.col("_given"))
    return good.select(*rows.columns).unionByName(bad.select(*rows.columns))


def quota_sample(rows: DataFrame, group: str, order: Sequence[str], total: int, per_group: int) -> DataFrame:
    """At most ``total`` rows in order, at most ``per_group`` of each group.

    The first ``per_group`` rows of a group are all that can be taken, and they are taken in order
    while places are left, so a rank within the group and a limit give the sequential result.
    """
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("_place", place).where(F.col("_place") <= per_group).drop("_place").orderBy(*order).limit(total)


def quota_until_full(rows: DataFrame, group: str, order: Sequence[str], total: int, per_group: int, enough: int) -> DataFrame:
    """As ``quota_sample``; nothing is taken if every group has at least ``enough`` rows already."""
    counts = rows.groupBy(group).count().agg(F.min("count").alias("_least"))
    return quota_sample(rows.join(F.broadcast(counts)).where(F.col("_least") < enough).drop("_least"), group, order, total, per_group)


def error_runs(rows: DataFrame, key: str, order: Sequence[str], failed: Column) -> DataFrame:
    """Runs of consecutive failures per key: (key, first, length), by gaps and islands."""
    w = Window.partitionBy(key).orderBy(*order)
    island = F.sum(F.when(failed, 0).otherwise(1)).over(w)
    marked = rows.select(key, *order, failed.alias("_failed"), island.alias("_island"))
    return marked.where("_failed").groupBy(key, "_island").agg(F.min(order[0]).alias("first"), F.count(F.lit(1)).alias("length")).drop("_island")


def provider_states(
    rows: DataFrame, key: str, order: Sequence[str], status: str, limited: int = 429, ok: int = 200, most: int = 2
) -> DataFrame:
    """State after each attempt: ``strikes`` and ``quarantined``.

    A rate limit adds a strike, a success clears them, any other status keeps the count, so strikes
    are the rate limits since the last success.
    """
    w = Window.partitionBy(key).orderBy(*order)
    era = F.sum(F.when(F.col(status) == ok, 1).otherwise(0)).over(w)
    strikes = F.sum(F.when(F.col(status) == limited, 1).otherwise(0)).over(Window.partitionBy(key, "_era").orderBy(*order))
    out = rows.withColumn("_era", era).withColumn("strikes", strikes)
    return out.withColumn("quarantined", F.col("strikes") >= most).drop("_era")


def sequential_quota(rows: DataFrame, group: str, order: Sequence[str], total: int, per_group: int, exclusive: str) -> DataFrame:
    """Quota sample in which a row is also refused if its ``exclusive`` value was taken before.

    What is refused depends on what was taken, across groups, so this is one ordered pass, over a
    bounded number of rows.  Of a group and exclusive value only the first row counts.  At most
    ``total`` exclusive values are taken, so the first total + per_group rows of a group decide for it;
    at most ``total`` groups are full, so the first total + 1 rows of an exclusive value decide for
    it.  What is taken, refused for its value or refused for its group is then at most
    total * (2 * total + per_group + 2) rows before the last place is gone.
    """
    first = F.row_number().over(Window.partitionBy(exclusive, group).orderBy(*order))
    candidates = rows.withColumn("_first", first).where("_first = 1").drop("_first")
    for key, most in ((group, total + per_group), (exclusive, total + 1)):
        place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
        candidates = candidates.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")
    candidates = candidates.orderBy(*order).limit(total * (2 * total + per_group + 2))

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        taken, groups, seen = 0, {}, set()
        for pdf in batches:
            keep = []
            for g, x in zip(pdf[group].tolist(), pdf[exclusive].tolist()):
                fits = taken < total and groups.get(g, 0) < per_group and x not in seen
                keep.append(fits)
                if fits:
                    taken, groups[g] = taken + 1, groups.get(g, 0) + 1
                    seen.add(x)
            yield pdf[pd.Series(keep, index=pdf.index, dtype=bool)]
            if taken >= total:
                return

    return candidates.orderBy(*order).coalesce(1).mapInPandas(take, rows.schema)


def representatives(rows: DataFrame, group: str, id: str, rank: Sequence[Column]) -> DataFrame:
    """The id with the smallest rank per group."""
    return rows.groupBy(group).agg(F.min_by(F.col(id), F.struct(*rank, F.col(id))).alias("representative"), F.count(F.lit(1)).alias("members"))
