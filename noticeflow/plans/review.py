"""Review of candidate articles: scan, match, dedup, enrich, score, group, and conserve the counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import dates, identity, text, urls
from ..operators import aggregates, components, joins, scoring
from ..operators.shared import Scratch


def ngram_candidates(rows: DataFrame, phrases: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of an n-gram scan that hold a phrase as whole words, the first of each canonical URL.

    ``rows`` comes from ``json_lines``: broken rows are left out, their number is in ``scan_counts``.
    """
    context = F.concat_ws(" ", "pre", "ngram", "post")
    hits = F.array_compact(F.array(*[F.when(text.has_phrase(context, p), F.lit(p)) for p in phrases]))
    good = rows.where(~F.col("malformed")).withColumns({
        "context": text.collapse(context), "matched": hits, "canonical_url": urls.canonical("url"), "domain": urls.host("url"), "article_time": dates.article_time("date"),
    }).where(F.size("matched") > 0)
    return joins.first_wins(good, ["canonical_url"], order).withColumn("candidate_id", identity.short_id(F.col("canonical_url")))


def scan_counts(rows: DataFrame, phrases: Sequence[str]) -> DataFrame:
    """One row: scanned, malformed, matched, distinct canonical URLs and duplicates of a scan."""
    context = F.concat_ws(" ", "pre", "ngram", "post")
    matched = F.lit(False)
    for p in phrases:
        matched = matched | text.has_phrase(context, p)
    marked = rows.select("malformed", (~F.col("malformed") & matched).alias("hit"), urls.canonical("url").alias("u"))
    out = marked.agg(
        F.count(F.lit(1)).alias("scanned"), F.count_if("malformed").alias("malformed"), F.count_if("hit").alias("matched"),
        F.count_distinct(F.when(F.col("hit"), F.col("u"))).alias("candidates"),
    )
    return out.withColumn("duplicates", F.col("matched") - F.col("candidates"))


def with_articles(candidates: DataFrame, articles: DataFrame, order: Sequence[str]) -> DataFrame:
    """Candidates with title, language and author of the last article of their canonical URL."""
    fields = ["title", "lang", "author", "description"]
    keyed = articles.withColumn("canonical_url", urls.canonical("url"))
    base = candidates.withColumns({c: F.lit(None).cast("string") for c in fields if c not in candidates.columns})
    return joins.enrich_last_wins(base, keyed, "canonical_url", order, fields)


def reviewed(candidates: DataFrame) -> DataFrame:
    """Candidates with relevance and language, as one row each."""
    body = F.concat_ws(" ", *[c for c in ("description", "context") if c in candidates.columns])
    out = candidates.withColumn("_r", scoring.relevance(F.col("title"), body, F.col("canonical_url")))
    guessed = text.script_language(F.concat_ws(" ", "title", body))
    return out.withColumns({
        "score": F.col("_r.score"), "decision": F.col("_r.decision"), "positives": F.col("_r.positives"), "exclusions": F.col("_r.exclusions"),
        "language": F.coalesce("lang", guessed["language"]), "language_conflict": F.col("lang").isNotNull() & (F.col("lang") != guessed["language"]),
    }).drop("_r")


def grouped(candidates: DataFrame, day: str = "article_time") -> DataFrame:
    """Duplicate groups of candidates: by canonical URL, by domain and title, or by nearly equal titles."""
    title = text.unicode_words("title")
    keys = {"canonical_url": F.col("canonical_url"), "domain_title": F.when(title != "", F.concat_ws("|", "domain", title))}
    edges = components.key_edges(candidates, "candidate_id", keys).unionByName(components.close_title_edges(candidates, "candidate_id", "title", "domain", day))
    return components.duplicate_groups(edges, ["canonical_url", "domain_title", "near_title"])


def report(candidates: DataFrame) -> DataFrame:
    """Counts of the review and the identities they must satisfy."""
    decisions = ("publish_candidate", "review_required", "irrelevant", "malformed")
    totals = candidates.agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("decision") == d).alias(d) for d in decisions],
        F.count_if(F.col("joined")).alias("joined"), F.count_if(~F.col("joined")).alias("unjoined"), F.count_distinct("candidate_id").alias("ids"),
    )
    return aggregates.conserved(totals, {
        "decisions_add_up": F.col("total") == sum((F.col(d) for d in decisions), F.lit(0)), "joins_add_up": F.col("total") == F.col("joined") + F.col("unjoined"),
        "ids_are_unique": F.col("ids") == F.col("total"),
    })


def report_counts() -> dict[str, Column]:
    """The counts of a review as aggregates over its candidates, by name.

    The candidates have ``decision`` (of :func:`reviewed`, malformed among them), ``group_id`` and ``representative`` of their duplicate group
    (null and false without one), ``country_status``, ``country_eligible``, ``joinable``, ``joined``, ``strength`` (strong, weak or excluded), ``noise``,
    ``positives``, ``exclusions``, ``language``.
    """
    c = F.col
    malformed = c("decision") == "malformed"
    member = ~malformed & c("group_id").isNotNull()
    suppressed = member & ~F.coalesce(c("representative"), F.lit(False))
    unique = ~malformed & ~suppressed
    eligible = unique & F.coalesce(c("country_eligible"), F.lit(False))
    joinable = unique & F.coalesce(c("joinable"), F.lit(False))
    decisions, states = ("publish_candidate", "review_required", "irrelevant"), ("confirmed", "inferred", "unresolved", "conflicting")
    counts = {
        "input": F.lit(True), "malformed": malformed, "valid": ~malformed, "duplicate_member": member, "duplicate_group": member & F.coalesce(c("representative"), F.lit(False)),
        "duplicate_suppressed": suppressed, "unique_valid": unique, "classified": unique & c("decision").isin(*decisions), "country_eligible": eligible, "join_attempt": joinable,
        "join_success": joinable & F.coalesce(c("joined"), F.lit(False)), "noise": F.coalesce(c("noise"), F.lit(False)), "with_positives": F.size("positives") > 0,
        "with_exclusions": F.size("exclusions") > 0, "language_known": unique & c("language").isNotNull(), "language_unknown": unique & c("language").isNull(),
    }
    for d in decisions:
        counts |= {f"{d}_input": c("decision") == d, f"{d}_unique": unique & (c("decision") == d), f"{d}_suppressed": suppressed & (c("decision") == d)}
    for s in states:
        counts |= {f"country_{s}_{k}": w & (c("country_status") == s) for k, w in (("input", F.lit(True)), ("valid", ~malformed), ("eligible", eligible))}
    counts |= {f"{s}_match": unique & (c("strength") == s) for s in ("strong", "weak", "excluded")}
    return {k: F.count_if(F.coalesce(v, F.lit(False))) for k, v in counts.items()}


def written_with_report(candidates: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The candidates as a table, and the report that was counted while they were written: one row of counts, ratios and identities.

    No second scan is made: the counts are metrics observed in the write.  ``all_hold`` tells whether all eight identities hold.
    """
    spark = candidates.sparkSession
    counts = report_counts()
    seen = Observation()
    kept = scratch.keep(candidates.observe(seen, *[v.alias(k) for k, v in counts.items()]), "candidates")
    found = seen.get if candidates.columns else {}
    row = spark.createDataFrame([tuple(int(found.get(k) or 0) for k in counts)], ", ".join(f"{k} long" for k in counts))
    c = F.col
    ratio = lambda a, b: F.when(c(b) > 0, F.round(c(a) / c(b), 4))
    total = lambda *names: sum((c(n) for n in names), F.lit(0).cast("bigint"))
    states = [f"country_{s}_eligible" for s in ("confirmed", "inferred", "unresolved", "conflicting")]
    row = row.withColumns({
        "country_success": total("country_confirmed_eligible", "country_inferred_eligible"), "join_ratio": ratio("join_success", "join_attempt"),
    }).withColumn("country_ratio", ratio("country_success", "country_eligible"))
    return kept, aggregates.conserved(row, {
        "inputs_hold": c("input") == total("valid", "malformed"),
        "valid_ones_hold": c("valid") == total("publish_candidate_input", "review_required_input", "irrelevant_input"),
        "duplicates_hold": c("unique_valid") == c("valid") - c("duplicate_suppressed"), "classes_hold": c("classified") == c("unique_valid"),
        "buckets_hold": c("classified") == total("publish_candidate_unique", "review_required_unique", "irrelevant_unique"),
        "input_buckets_hold": c("input") == total("malformed", "duplicate_suppressed", "publish_candidate_unique", "review_required_unique", "irrelevant_unique"),
        "countries_hold": c("country_eligible") == total(*states), "country_successes_hold": c("country_success") == c("country_eligible") - total("country_unresolved_eligible", "country_conflicting_eligible"),
    })
