"""Detail pages of boards to records and items: fields by label and place, verdicts on page and link, versioned updates.

A page becomes lines, as its block elements part them, and fields are looked for line by line: a label decides
which line counts, and the value that stands with it is taken from there.  Each record
carries what speaks against it, so that nothing is dropped without a reason.  Null pages are empty ones, and
columns beyond those named stay.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html
from ..functions.text import any_term, col, collapse
from . import scoring


# The words by which notices are told apart, the labels of their fields, and words of pages that refuse.
@dataclass(frozen=True)
class Words:
    contest: Sequence[str] = (
        "민간참여 공공주택건설사업", "민간참여 공공주택사업", "민간참여 공공주택", "민간사업자 공모", "민간사업자 재공모", "민간사업자 선정 공모", "공공주택 민간사업자",
    )
    housing: Sequence[str] = ("공공주택", "공동주택", "주택건설", "공공분양", "임대주택", "주거단지", "행복주택")
    result: Sequence[str] = ("평가결과", "심사결과", "선정결과", "우선협상대상자", "평가위원", "계약체결")
    schedule: Sequence[str] = ("제출", "접수", "마감", "참가의향서", "사업신청서", "공모일정")
    deadline: Sequence[str] = ("사업신청서", "접수 마감", "제출 마감", "마감일", "신청서 접수")
    amount: Sequence[str] = ("추정사업비", "추정 사업비", "사업비", "예산")
    summary: Sequence[str] = ("민간참여", "공공주택", "공모", "사업", "제출", "접수", "대상")
    place: Sequence[str] = ("지구", "신도시", "구역")
    block: Sequence[str] = ("BL", "블록")
    homes: str = "세대"
    refused: Sequence[str] = ("captcha", "access denied", "forbidden", "접근 제한", "잘못된 접근")
    keywords: Sequence[str] = field(default=("민간참여 공공주택", "민간사업자 공모"))


WORDS = Words()
#: Characters from a label to its amount, of a page that decide whether it refuses, of a summary; lines of a schedule and a summary.
LABEL_REACH, REFUSAL_WINDOW, SUMMARY_LENGTH, SCHEDULE_LINES, SUMMARY_LINES = 30, 3000, 1200, 5, 4
DATE = r"20\d{2}(?:[./-]\s*\d{1,2}[./-]\s*\d{1,2}|년\s*\d{1,2}월\s*\d{1,2}일)"
BLOCK_ENDS = r"(?i)<br\s*/?>|</(?:p|div|li|tr|h[1-6]|td|th|dt|dd|title|table|ul|ol|article|section)\s*>"


def lines(page: Column | str, bare: bool = True) -> Column:
    """Array of the page's lines that are not blank: block elements and breaks end a line, references are decoded."""
    t = F.regexp_replace(F.coalesce(col(page), F.lit("")), r"(?is)<(script|style|noscript)\b.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"\s+", " "), BLOCK_ENDS, "\n")
    t = html.unescaped(F.regexp_replace(t, r"<[^>]*>", " "), bare)
    return F.filter(F.transform(F.split(t, "\n"), collapse), lambda x: x != "")


def _with_any(found: Column, words: Sequence[str]) -> Column:
    return F.filter(found, lambda x: any_term(x, list(words)))


def schedule(found: Column, words: Words = WORDS, least: int = 8) -> Column:
    """The first lines of some length that speak of the schedule, a line each; null without any."""
    hit = F.slice(F.filter(_with_any(found, words.schedule), lambda x: F.char_length(x) >= least), 1, SCHEDULE_LINES)
    return F.when(F.size(hit) > 0, F.array_join(hit, "\n"))


def dates(text: Column) -> Column:
    """Array of the days named in a text, in order; impossible ones are left out."""
    named = F.regexp_extract_all(text, F.lit(DATE), F.lit(0))
    number = lambda d, k: F.get(F.regexp_extract_all(d, F.lit(r"\d+"), F.lit(0)), k)
    day = lambda d: F.concat_ws("-", number(d, 0), F.lpad(number(d, 1), 2, "0"), F.lpad(number(d, 2), 2, "0")).try_cast("date")
    return F.array_compact(F.transform(named, day))


def deadline(found: Column, words: Words = WORDS) -> Column:
    """The last day in the first line that speaks of the end of applications and names a day."""
    days = F.filter(F.transform(_with_any(found, words.deadline), dates), lambda d: F.size(d) > 0)
    return F.element_at(F.get(days, 0), -1)


def amount(found: Column, words: Words = WORDS) -> Column:
    """The first amount that follows a label closely, in whole units; those in hundreds of millions before others."""
    label = f"(?:{'|'.join(words.amount)})[^\\n]{{0,{LABEL_REACH}}}?"
    text = F.array_join(found, "\n")
    number = lambda unit: F.regexp_replace(F.regexp_extract(text, f"{label}([0-9][0-9,]*)\\s*{unit}", 1), ",", "").try_cast("bigint")
    return F.coalesce(number("억\\s*원") * 100_000_000, number("원"))


def homes(found: Column, words: Words = WORDS) -> Column:
    """The first count of homes."""
    return F.regexp_replace(F.regexp_extract(F.array_join(found, "\n"), f"([0-9][0-9,]*)\\s*{words.homes}", 1), ",", "").try_cast("bigint")


def named(title: Column, found: Column, ends: Sequence[str], body: str, most: int = 5) -> Column:
    """The first distinct names in title and lines that end in one of the words."""
    text = F.concat_ws("\n", title, F.array_join(found, "\n"))
    hit = F.regexp_extract_all(text, F.lit(f"(?i){body}(?:{'|'.join(ends)})"), F.lit(0))
    return F.slice(F.array_distinct(F.transform(hit, collapse)), 1, most)


def summary(found: Column, words: Words = WORDS) -> Column:
    return F.substring(F.array_join(F.slice(_with_any(found, words.summary), 1, SUMMARY_LINES), " / "), 1, SUMMARY_LENGTH)


def flags(text: Column, words: Words = WORDS) -> Column:
    """Struct of what a text speaks of: contest, housing, result."""
    return F.struct(*[any_term(text, list(getattr(words, k))).alias(k) for k in ("contest", "housing", "result")])


def kind(text: Column, words: Words = WORDS) -> Column:
    """Struct (status, stage): a result, a confirmed notice, one to review, or excluded."""
    f = flags(text, words)
    pair = lambda a, b: F.struct(F.lit(a).alias("status"), F.lit(b).alias("stage"))
    return (
        F.when(f["contest"] & f["result"], pair("result", "result")).when(f["contest"] & f["housing"], pair("confirmed", "notice"))
        .when(f["contest"], pair("review_required", "unknown")).otherwise(pair("excluded", "unknown"))
    )


def same_title(expected: Column, title: Column, found: Column) -> Column:
    """Whether a page bears the title: as it is but for spaces, or up to three of its longer words."""
    packed = lambda t: F.regexp_replace(t, r"\s+", "")
    body = F.array_join(found, " ")
    whole = (packed(expected) != "") & F.contains(packed(F.concat_ws(" ", title, body)), packed(expected))
    terms = F.filter(F.split(expected, r"[\s\[\]().,·ㆍ:_-]+"), lambda t: F.char_length(t) >= 4)
    hits = F.size(F.filter(terms, lambda t: F.contains(title, t) | F.contains(body, t)))
    return whole | (hits >= F.greatest(F.lit(1), F.least(F.lit(3), F.size(terms))))


def verdict(url: Column, hosts: Sequence[str], record: Column, expected: Column, title: Column, found: Column, status: Column, words: Words = WORDS) -> Column:
    """Why a page is not the record's own: the first of address, id, status, refusal and title that fails; else verified."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://(?:[^/@]*@)?([^/:?#]+)", 1))
    allowed = F.exists(F.array(*map(F.lit, hosts)), lambda h: (host == h) | F.endswith(host, F.concat(F.lit("."), h)))
    start = F.lower(F.substring(F.array_join(found, "\n"), 1, REFUSAL_WINDOW))
    return (
        F.when(~F.coalesce(allowed, F.lit(False)), "domain_not_allowed").when(F.coalesce(record, F.lit("")) == "", "record_id_missing")
        .when(~F.contains(url, record), "record_id_not_in_address").when(~F.coalesce(status == 200, F.lit(False)), F.concat(F.lit("http_"), F.coalesce(status.cast("string"), F.lit("none"))))
        .when(F.size(found) == 0, "empty_page").when(any_term(start, list(words.refused)), "access_restricted").when(~same_title(F.coalesce(expected, F.lit("")), title, found), "title_mismatch").otherwise("verified")
    )


def bound(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """The rows with one more column, which is computed once a row however often it is read."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def detail_records(pages: DataFrame, hosts: Sequence[str], words: Words = WORDS, bare: bool = True) -> DataFrame:
    """Pages (source, record_id, listed_title, url, status, html and more) with the record's fields and its ``outcome``.

    ``outcome``: ``opportunity`` for confirmed notices whose link is verified, ``result``, ``review``, ``unverified``
    (a confirmed notice, reason in ``link_reason``), ``excluded`` for pages that speak of no contest, ``failed`` for pages
    that were not read.  ``bare``: whether character references count without their semicolon too.
    """
    # a page is taken apart once, and a generator's rows are no expressions that Catalyst would repeat in a filter or for each
    # field that reads them; the fields after them are columns of their own, so that those nobody reads are not computed
    p = bound(pages, "_page", F.struct(
        lines("html", bare).alias("lines"), html.title("html", bare).alias("page_title"), html.attachments("html", bare=bare).alias("attachments"), collapse("listed_title").alias("listed"),
        F.coalesce((F.col("status") == 200) & (F.coalesce("html", F.lit("")) != ""), F.lit(False)).alias("read"),
    ))
    r, found = F.col("_page"), F.col("_page.lines")
    title = F.coalesce(F.nullif(r["page_title"], F.lit("")), r["listed"])
    text = F.concat_ws(" ", title, F.array_join(found, " "), F.array_join(F.transform(r["attachments"], lambda a: a["name"]), " "))
    p = bound(p, "_text", F.struct(title.alias("title"), text.alias("text")))
    title, text = F.col("_text.title"), F.col("_text.text")
    expected = F.coalesce(F.nullif(r["listed"], F.lit("")), title)
    reason = verdict(F.col("url"), hosts, F.col("record_id"), expected, title, found, F.col("status"), words)
    p = bound(p, "_own", F.struct(kind(text, words).alias("kind"), reason.alias("link_reason")))
    own = F.col("_own.kind")
    outcome = (
        F.when(~r["read"], "failed").when(own["status"] == "excluded", "excluded").when(own["status"] == "result", "result").when(own["status"] != "confirmed", "review")
        .when(F.col("_own.link_reason") == "verified", "opportunity").otherwise("unverified")
    )
    return p.withColumns({
        "page_title": r["page_title"], "title": title, "attachments": r["attachments"], "class": own["status"], "stage": own["stage"], "link_reason": F.col("_own.link_reason"),
        "posted_at": F.get(dates(F.array_join(found, "\n")), 0), "deadline_at": deadline(found, words), "schedule": schedule(found, words), "amount": amount(found, words), "homes": homes(found, words),
        "sites": named(title, found, words.place, r"[\p{L}0-9·ㆍ-]{2,40}?"), "blocks": named(title, found, words.block, r"\b[\p{L}0-9-]{1,16}\s?"),
        "summary": summary(found, words), "modular": scoring.modular_relevance(text), "outcome": outcome,
    }).drop("_page", "_text", "_own")


def detail_items(records: DataFrame, words: Words = WORDS) -> DataFrame:
    """Items of the records that are opportunities, to be reviewed or unverified, with their hash and score.

    A record whose link is not verified keeps the board's address (``board_url``) and counts as out of scope.
    """
    sure = F.col("outcome") == "opportunity"
    exact = F.col("link_reason") == "verified"
    keywords = F.array_distinct(F.concat(F.array(*map(F.lit, words.keywords)), F.array("source"), F.col("modular.evidence")))
    return records.where(F.col("outcome").isin("opportunity", "review", "unverified", "result")).select(
        F.sha2(F.concat_ws("|", "source", "record_id"), 256).alias("unique_hash"), "source", "record_id", "title", "posted_at", F.col("deadline_at").alias("due_at"), "amount",
        F.nullif(F.array_join("sites", ", "), F.lit("")).alias("region"), F.array_join(keywords, "; ").alias("keywords"), "summary",
        F.when(exact, F.col("url")).otherwise(F.col("board_url")).alias("url"), (70 + F.col("modular.score")).alias("relevance_score"),
        F.when(exact, "exact").otherwise("unknown").alias("link_type"), F.col("stage").alias("notice_status"), sure.alias("in_scope"), F.col("link_reason").alias("link_reason"),
    )


def outcomes(records: DataFrame) -> DataFrame:
    """Per source and outcome: pages, verified links, pages with deadline and amount."""
    return records.groupBy("source", "outcome").agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(F.col("link_reason") == "verified").alias("verified"), F.count("deadline_at").alias("deadlines"),
        F.count("amount").alias("amounts"), F.sum(F.size("attachments")).cast("long").alias("attachments"),
    )


def compare_and_set(stored: DataFrame, changes: DataFrame, key: str, version: str, columns: Sequence[str]) -> DataFrame:
    """The stored rows after changes that name the version they were made from, with ``status``.

    A change applies if its version is the stored one; the row then gets the next version and the change's
    ``columns``.  Of several changes of a row for its version the one with the smallest columns
    counts.  ``status``: kept, set, conflict (changes came, none for the stored version); changes of rows that are not
    stored come as rows of their own with status missing, without a version.
    """
    c = changes.groupBy(key, version).agg(F.min(F.struct(*columns)).alias("_new"))
    c = c.groupBy(F.col(key).alias("_key")).agg(F.map_from_entries(F.collect_list(F.struct(F.col(version), F.col("_new")))).alias("_changes"))
    both = stored.join(c, F.col(key) == F.col("_key"), "full")
    new = F.try_element_at(F.col("_changes"), F.col(version))
    status = F.when(F.col(key).isNull(), "missing").when(F.col("_changes").isNull(), "kept").when(new.isNotNull(), "set").otherwise("conflict")
    out = both.withColumn("_status", status).withColumn("_set", new)
    own = {c: F.when(F.col("_status") == "set", F.col(f"_set.{c}")).otherwise(F.col(c)).alias(c) for c in columns}
    own |= {key: F.coalesce(key, "_key").alias(key), version: F.when(F.col("_status") == "set", F.col(version) + 1).otherwise(F.col(version)).alias(version)}
    return out.select(*[own.get(c, F.col(c)) for c in stored.columns], F.col("_status").alias("status"))
