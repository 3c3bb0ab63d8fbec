"""Relevance of items and candidates, stages, and resolution of evidence.  Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import terms as T
from ..functions.text import any_term, ascii_words, collapse, first_stage, matched_terms


def _score(*parts: Column | int) -> Column:
    total = F.lit(0)
    for p in parts:
        total = total + p
    return F.least(F.lit(100), total).cast("double")


def _if(condition: Column, points: int) -> Column:
    return F.when(condition, points).otherwise(0)


def _each(text: Column, words, points: int) -> Column:
    return F.size(matched_terms(text, words)) * points


def tender_relevance(title: Column, details: Column, organisations: Column) -> Column:
    """+5 per keyword of the title, +1 per keyword of the details, +2 organisation, +5 direct; 100 at most."""
    return _score(
        _each(title, T.KEYWORDS, 5), _each(details, T.KEYWORDS, 1), _if(any_term(organisations, T.ORGANISATIONS), 2),
        _if(any_term(F.concat_ws(" ", title, details), T.DIRECT), 5),
    )


def housing_relevance(title: Column, details: Column, organisations: Column, has_amount: Column) -> Column:
    return _score(
        _if(any_term(title, T.DIRECT), 10), _if(any_term(title, T.HOUSING_CONTEXT), 5),
        _if(any_term(organisations, ("lh", "한국토지주택공사", "본사")), 2), _each(details, T.KEYWORDS, 1), _if(has_amount, 1),
    )


def defence_relevance(title: Column, details: Column, kind: Column, extra: Column) -> Column:
    """10 direct, 6 facility, 5 works, and what the source adds; 0 without any keyword."""
    score = _score(_if(any_term(title, T.DIRECT), 10), _if(any_term(title, T.FACILITIES), 6), _if(any_term(kind, ("시설", "공사")), 5), extra)
    return F.when(any_term(F.concat_ws(" ", title, details), T.KEYWORDS), score).otherwise(0.0)


def news_relevance(title: Column, summary: Column, posted: Column, as_of: Column, has_keyword: Column) -> Column:
    age = F.datediff(as_of, posted)
    score = _score(
        _if(any_term(title, T.DIRECT), 10), _if(any_term(title, T.PUBLIC_BODIES), 6), _if(any_term(title, T.COMPETITORS), 5),
        _if(any_term(summary, T.DIRECT), 3), F.when(age <= 7, 3).when(age <= 30, 1).otherwise(0),
    )
    return F.when(any_term(F.concat_ws(" ", title, summary), T.NEWS_VETOES) | ~has_keyword, 0.0).otherwise(score)


def plan_relevance(title: Column, target: Column, description: Column, keyword: str = "모듈러") -> Column:
    return _score(_if(any_term(title, [keyword]), 10), _if(any_term(target, [keyword]), 6), _if(any_term(description, [keyword]), 2))


def generic_relevance(given: Column, keywords: Column) -> Column:
    """The given score, else 50 and 10 per keyword up to 100, else 0."""
    n = F.size(keywords)
    return F.coalesce(given.cast("string").try_cast("double"), F.when(n > 0, F.least(F.lit(100.0), 50.0 + 10.0 * n)).otherwise(0.0))


def notice_stage(title: Column, body: Column) -> Column:
    return first_stage(F.concat_ws(" ", title, body), T.NOTICE_STAGES, "unknown")


def notice_title(title: Column) -> Column:
    """Title without stage terms, year and round, brackets and separators."""
    t = collapse(title)
    for w in T.TITLE_DROPS:
        t = F.replace(t, F.lit(w), F.lit(" "))
    t = F.regexp_replace(t, r"\b20\d{2}\s*년?\s*제?\s*\d+\s*차", " ")
    return collapse(F.regexp_replace(F.regexp_replace(t, r"\[[^\]]+\]|\([^)]+\)", " "), r"[-_·ㆍ:]+", " "))


def modular_relevance(text: Column) -> Column:
    """Struct (value, score, evidence): confirmed by a term, a candidate by its contest, or unconfirmed."""
    t = collapse(text)
    found = matched_terms(t, T.CONFIRMED)
    result = lambda v, s, e: F.struct(F.lit(v).alias("value"), F.lit(s).alias("score"), e.alias("evidence"))
    return (
        F.when(F.size(found) > 0, result("confirmed", 10, found))
        .when(any_term(t, T.HOUSING_CONTESTS), result("review_candidate", 3, F.array(F.lit("민간참여 공공주택 공모"))))
        .otherwise(result("unconfirmed", 0, F.array().cast("array<string>")))
    )


def _phrases(padded: Column, words) -> Column:
    """The phrases that stand in a text of ASCII words with spaces at both ends, as whole words."""
    known = F.array(*[F.struct(F.lit(w).alias("term"), F.lit(f" {_plain(w)} ").alias("phrase")) for w in words])
    return F.transform(F.filter(known, lambda k: F.contains(padded, k["phrase"])), lambda k: k["term"])


def _plain(phrase: str) -> str:
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in phrase.lower()).split())


def relevance(title: Column, body: Column, url: Column, noise: Column | None = None) -> Column:
    """Struct (score, decision, positives, exclusions) of a candidate article.

    Strong and supporting terms, context weights, exclusions and probe noise add up to 0..100.  A
    weak term counts once, where no keyword but some context was found.  Missing title or address is
    malformed; exclusions below the upper limit are irrelevant, at or above it they need review.
    """
    padded = F.concat(F.lit(" "), ascii_words(F.concat_ws(" ", title, body, url)), F.lit(" "))
    strong, supporting, weak = (_phrases(padded, w) for w in (T.STRONG_TERMS, T.SUPPORTING_TERMS, T.WEAK_TERMS))
    context, excluded = _phrases(padded, T.CONTEXT_WEIGHTS), _phrases(padded, T.EXCLUSION_TERMS)
    hit = lambda words: F.size(_phrases(padded, words)) > 0 if words else F.lit(False)
    rules = F.array_compact(F.array(*[F.when(hit(a) | (hit(b) & hit(c)), F.lit(name)) for name, (a, b, c) in T.EXCLUSION_RULES.items()]))
    context_score = sum((F.when(F.array_contains(context, w), n).otherwise(0) for w, n in T.CONTEXT_WEIGHTS.items()), F.lit(0))
    noisy = F.coalesce(noise, F.lit(False)) if noise is not None else F.lit(False)
    keyword = (F.size(strong) > 0) | (F.size(supporting) > 0)
    total = (
        F.size(strong) * T.STRONG_WEIGHT + F.size(supporting) * T.SUPPORTING_WEIGHT + context_score + F.size(excluded) * T.EXCLUSION_WEIGHT
        + _if(noisy, T.NOISE_WEIGHT) + _if(~keyword & (F.size(weak) > 0) & (F.size(context) > 0), T.WEAK_WEIGHT)
    )
    score = F.greatest(F.lit(0), F.least(F.lit(100), total))
    tag = lambda kind, found: F.transform(found, lambda t: F.concat(F.lit(f"{kind}:"), t))
    exclusions = F.concat(rules, tag("strong_exclusion", excluded), F.when(noisy, F.array(F.lit("probe_noise"))).otherwise(F.array().cast("array<string>")))
    missing = (F.trim(F.coalesce(title, F.lit(""))) == "") | (F.trim(F.coalesce(url, F.lit(""))) == "")
    has_exclusion = F.size(exclusions) > 0
    decision = (
        F.when(missing, "malformed").when(has_exclusion & (score < T.PUBLISH_AT), "irrelevant").when(~has_exclusion & (score >= T.PUBLISH_AT), "publish_candidate")
        .when(score >= T.REVIEW_AT, "review_required").otherwise("irrelevant")
    )
    positives = F.concat(tag("strong_positive", strong), tag("supporting_positive", supporting), tag("construction_context", context))
    return F.struct(F.when(missing, 0).otherwise(score).alias("score"), decision.alias("decision"), positives.alias("positives"), exclusions.alias("exclusions"))


def resolve_evidence(evidence: Column, sure: float = 0.95) -> Column:
    """Struct (value, status, confidence) from an array of structs (source, value, confidence).

    One sure value is confirmed, two different sure values conflict; otherwise at least two pieces
    for one and the same value infer it, with the largest confidence.
    """
    known = F.filter(evidence, lambda e: e["value"].isNotNull() & (e["value"] != ""))
    certain = F.array_sort(F.array_distinct(F.transform(F.filter(known, lambda e: e["confidence"] >= sure), lambda e: e["value"])))
    values = F.array_sort(F.array_distinct(F.transform(known, lambda e: e["value"])))
    best = F.array_max(F.transform(known, lambda e: e["confidence"]))
    status = (
        F.when(F.size(certain) == 1, "confirmed")
        .when(F.size(certain) > 1, "conflicting")
        .when((F.size(values) == 1) & (F.size(known) >= 2), "inferred")
        .when(F.size(values) > 1, "conflicting")
        .otherwise("unresolved")
    )
    value = F.when(status == "confirmed", F.get(certain, F.lit(0))).when(status == "inferred", F.get(values, F.lit(0)))
    return F.struct(value.alias("value"), status.alias("status"), F.when(value.isNotNull(), best).alias("confidence"))
