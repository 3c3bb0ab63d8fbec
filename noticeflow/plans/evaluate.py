"""Evaluation of samples, provider health and checkpoints."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import ratio
from ..operators import joins

# What an evaluation must reach.
LEAST_SAMPLES, LEAST_LABELS, LEAST_RELEVANT, LEAST_IRRELEVANT = 6, 20, 0.90, 0.95


def sample_status(has_error: Column, flags: Sequence[Column]) -> Column:
    """incomplete with an error, success if all flags hold, else failed."""
    ok = F.lit(True)
    for f in flags:
        ok = ok & F.coalesce(f, F.lit(False))
    return F.when(has_error, "incomplete").when(ok, "success").otherwise("failed")


def decision(samples: Column, labels: Column, relevant: Column, irrelevant: Column) -> Column:
    """What an evaluation allows; too few samples or labels come before the precisions."""
    return (
        F.when(samples < LEAST_SAMPLES, "insufficient_samples")
        .when(labels < LEAST_LABELS, "insufficient_labels")
        .when((F.coalesce(relevant, F.lit(0.0)) < LEAST_RELEVANT) | (F.coalesce(irrelevant, F.lit(0.0)) < LEAST_IRRELEVANT), "below_threshold")
        .otherwise("accepted")
    )


def totals(samples: DataFrame, counts: Sequence[str]) -> DataFrame:
    """One row: samples by status, sums of their counts and the share of successes."""
    states = ("success", "failed", "incomplete")
    out = samples.agg(
        F.count(F.lit(1)).alias("samples"), *[F.count_if(F.col("status") == s).alias(s) for s in states],
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts],
    )
    return out.withColumn("success_rate", ratio(F.col("success"), F.col("samples")))


def pack_quality(rows: DataFrame, packs: str, noise: str) -> DataFrame:
    """Per pack of an array column: observations, noisy ones and their share."""
    each = rows.select(F.explode(packs).alias("pack"), (F.size(noise) > 0).alias("noisy"))
    out = each.groupBy("pack").agg(F.count(F.lit(1)).alias("observations"), F.count_if("noisy").alias("noisy"))
    return out.withColumn("noise_ratio", ratio(F.col("noisy"), F.col("observations")))


def query_manifest(countries: DataFrame, packs: Mapping[str, Sequence[str]]) -> DataFrame:
    """Every country with every pack, its distinct terms in order and the fingerprint of the query."""
    rows = [F.struct(F.lit(n).alias("pack"), F.lit(" OR ".join(f'"{t}"' for t in dict.fromkeys(t.lower() for t in terms))).alias("query")) for n, terms in packs.items()]
    out = countries.withColumn("_p", F.explode(F.array(*rows))).select(*countries.columns, "_p.pack", "_p.query")
    return out.withColumn("fingerprint", F.sha2(F.concat_ws("|", "country", "pack", "query"), 256))


def stale_checkpoints(checkpoint: DataFrame, manifest: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Checkpoint rows whose query has changed since, or is asked no more."""
    now = manifest.select(*keys, F.col("fingerprint").alias("_now"))
    return checkpoint.join(now, list(keys), "left").where(~F.col("fingerprint").eqNullSafe(F.col("_now"))).drop("_now")


def cooldowns(attempts: DataFrame, key: str, order: Sequence[str], now: Column, seconds: Mapping[int, int], default: int) -> DataFrame:
    """Newest attempt per provider and whether it still cools down, by the status it got."""
    newest = joins.latest(attempts, [key], order)
    wait = F
    for status, s in seconds.items():
        wait = wait.when(F.col("status") == status, s)
    until = F.timestamp_seconds(F.unix_timestamp("at") + wait.otherwise(default))
    return newest.withColumn("until", until).withColumn("cooling", now < F.col("until"))


def choose(rows: DataFrame, bad_query: Column, quarantined: Column, cooling: Column) -> DataFrame:
    """Why a provider is skipped: a bad query before quarantine before cooling down; null to ask it."""
    return rows.withColumn("skip", F.when(bad_query, "bad_query").when(quarantined, "quarantined").when(cooling, "cooling_down"))
