"""Raw records of the sources to items of one schema.

``normalise`` makes one pass: each output column is a choice by source of the first present alias.
Raw records are a table of text columns with the sources' own names; a map column ``raw`` may hold
further fields.  Columns that a table does not have count as missing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, identity, numbers
from ..functions import terms as T
from ..functions.text import any_term, matched_terms, present
from ..operators import scoring

# Names of sources and kinds, and the portals of the sources.
G2B, LH, D2B, NEWS = "나라장터", "LH", "D2B", "네이버뉴스"
BID, PLAN, ARTICLE = "bid", "procurement_plan", "news"
PORTALS = {G2B: "https://www.g2b.go.kr/", LH: "https://ebid.lh.or.kr/", D2B: "https://www.d2b.go.kr/"}
PORTAL_NAMES = {G2B: "나라장터", LH: "LH 전자조달", D2B: "국방전자조달", NEWS: "네이버뉴스"}
RECORD_IDS = ("source_record_id", "bid_no", "notice_no", "dcs_no", "bidNum", "bidNtceNo", "raw.bidNtceNo", "raw.bidNo", "raw.bidNum", "raw.pblancNo", "raw.g2bPblancNo", "raw.dcsNo", "raw.dcsNoNm")
RECORD_NOS = ("source_record_no", "bid_order", "raw.bidNtceOrd", "raw.bidOdr", "raw.pblancOdr", "raw.g2bPblancNoOdr")
DETAIL_URLS = ("detail_url", "original_url", "raw.bidNtceDtlUrl", "raw.ntceDtlUrl", "raw.dtlUrl", "raw.detailUrl")
SUMMARY_KEYWORD_FIELDS = ("title", "summary", "description", "keywords", "organization", "demand_org", "category", "progress_status", "contract_method", "bid_method")

# What every item has, with the aliases of a source without rules of its own.
GENERIC = {
    "title": ("title",), "organization": ("organization",), "posted_at": ("posted_at",), "due_at": ("due_at",), "amount": ("amount",),
    "region": ("region",), "summary": ("summary", "description"), "url": ("url",), "bid_no": ("bid_no",), "bid_order": ("bid_order",),
    "notice_status": ("notice_status",), "business_type": ("business_type", "category"), "business_subtype": ("business_subtype",),
    "contract_method": ("contract_method",), "bid_method": ("bid_method",), "demand_org": ("demand_org",), "notice_org": ("notice_org",),
}


@dataclass(frozen=True)
class Source:
    """Rules of a source: other aliases, labels of the made-up summary, defaults, and the relevance."""

    name: str
    kind: str | None
    aliases: dict[str, tuple[str, ...]] = field(default_factory=dict)
    summary: tuple[tuple[str, tuple[str, ...]], ...] = ()
    defaults: dict[str, str] = field(default_factory=dict)
    relevance: Callable[[Reader, Column], Column] | None = None


class Reader:
    """Expressions over the columns that a table of raw records has."""

    def __init__(self, df: DataFrame):
        self.columns, self.has_map = set(df.columns), "raw" in df.columns

    def one(self, name: str) -> Column:
        if name.startswith("raw."):
            return F.nullif(F.trim(F.col("raw")[name[4:]]), F.lit("")) if self.has_map else F.lit(None).cast("string")
        return F.nullif(F.trim(F.col(name).cast("string")), F.lit("")) if name in self.columns else F.lit(None).cast("string")

    def first(self, *names: str) -> Column:
        return F.coalesce(*[self.one(n) for n in names], F.lit(None).cast("string"))

    def joined(self, *names: str) -> Column:
        return F.concat_ws(" ", *[F.coalesce(self.one(n), F.lit("")) for n in names])


def _g2b(r: Reader, as_of: Column) -> Column:
    return scoring.tender_relevance(r.joined("title"), r.joined("summary", "description"), r.joined("organization", "demand_org"))


def _lh(r: Reader, as_of: Column) -> Column:
    return scoring.housing_relevance(r.joined("title"), r.joined("summary", "description"), r.joined("organization", "region"), r.one("amount").isNotNull())


def _d2b_plan(r: Reader, as_of: Column) -> Column:
    extra = F.when(r.one("amount").isNotNull(), 1).otherwise(0) + F.when(any_term(r.joined("progress_status"), T.ACTIVE), 2).otherwise(0)
    return scoring.defence_relevance(r.joined("title"), r.joined("summary", "description"), F.coalesce(r.first("execution_type", "category"), F.lit("")), extra)


def _d2b_bid(r: Reader, as_of: Column) -> Column:
    extra = F.when(r.first("bid_submission_deadline", "registration_deadline").isNotNull(), 2).otherwise(0) + F.when(any_term(r.joined("organization"), T.DEFENCE), 2).otherwise(0)
    return scoring.defence_relevance(r.joined("title"), r.joined("summary"), F.coalesce(r.first("business_type", "category"), F.lit("")), extra)


def _news(r: Reader, as_of: Column) -> Column:
    posted = dates.any_date(r.first("posted_at", "pub_date"))
    words = [w for pack in T.NEWS_PACKS.values() for w in pack] + list(T.DIRECT)
    has = any_term(r.joined("title", "summary"), words) | r.first("keyword_query", "keywords").isNotNull()
    return scoring.news_relevance(r.joined("title"), r.joined("summary"), posted, as_of, has)


# The sources with their names, aliases and rules.
SOURCES = (
    Source(
        G2B, PLAN,
        {"bid_no": ("plan_no", "source_record_id", "bid_no"), "bid_order": ("source_record_no",), "amount": ("amount", "raw.sumOrderAmt", "raw.orderAmt", "raw.bdgtAmt", "raw.budgetAmt"),
         "notice_org": ("organization",), "summary": ("summary",)},
        (("발주계획번호", ("plan_no", "source_record_id", "bid_no")), ("발주예정", ("due_at",)), ("업무구분", ("business_type", "category")), ("계약방법", ("contract_method",)),
         ("입찰방법", ("bid_method",)), ("발주기관", ("organization",)), ("수요기관", ("demand_org",)), ("예산액", ("amount", "raw.sumOrderAmt", "raw.orderAmt", "raw.bdgtAmt", "raw.budgetAmt"))),
        {"business_subtype": "발주계획", "operating_scope": "modular_procurement_plan"},
    ),
    Source(
        G2B, None,
        {"organization": ("organization", "demand_org"), "bid_no": ("bidNtceNo", "source_record_id"), "bid_order": ("bidNtceOrd", "source_record_no"), "business_type": ("category", "bsnsDivNm"),
         "business_subtype": ("business_subtype", "srvceDivNm", "category", "bsnsDivNm"), "notice_status": ("ntceKindNm", "notice_status"), "contract_method": ("contract_method", "cntrctCnclsMthdNm"),
         "bid_method": ("bid_method", "bidMethdNm"), "notice_org": ("notice_org", "organization")},
        (("공고번호", ("bidNtceNo", "source_record_id")), ("공고차수", ("bidNtceOrd", "source_record_no")), ("업무구분", ("category", "bsnsDivNm")), ("공고상태", ("ntceKindNm", "notice_status")),
         ("계약방법", ("contract_method", "cntrctCnclsMthdNm")), ("입찰방법", ("bid_method", "bidMethdNm")), ("공고기관", ("notice_org", "organization")), ("수요기관", ("demand_org",)), ("마감일", ("due_at",))),
        {}, _g2b,
    ),
    Source(
        LH, None, {"summary": ("summary",)},
        (("공고번호", ("bid_no",)), ("담당지역", ("region",)), ("추정가격", ("raw.presmtPrc",)), ("기초금액", ("raw.fdmtlAmt",)), ("계약유형", ("category",))),
        {"organization": "한국토지주택공사"}, _lh,
    ),
    Source(
        D2B, PLAN,
        {"title": ("title", "raw.reprsntPrdlstNm"), "organization": ("organization", "region"), "posted_at": ("posted_at", "order_month"), "due_at": ("due_at", "order_month", "posted_at"),
         "amount": ("amount", "raw.bdgtAmount", "raw.budgetAmount", "raw.bdgtAmt"), "bid_no": ("plan_no", "dcs_no", "source_record_id"), "bid_order": ("source_record_no",),
         "notice_status": ("notice_status", "progress_status"), "notice_org": ("organization",), "summary": ("summary",)},
        (("판단번호", ("dcs_no",)), ("발주예정월", ("order_month", "posted_at")), ("계약방법", ("contract_method",)), ("입찰방법", ("bid_method",)), ("진행상태", ("progress_status",)),
         ("예산금액", ("amount", "raw.bdgtAmount", "raw.budgetAmount", "raw.bdgtAmt"))),
        {"business_subtype": "조달계획", "operating_scope": "modular_procurement_plan"}, _d2b_plan,
    ),
    Source(
        D2B, BID,
        {"title": ("title", "bid_name"), "due_at": ("bid_submission_deadline", "registration_deadline", "due_at"), "amount": ("amount", "raw.budgetAmount", "raw.bdgtAmount"),
         "region": ("region", "organization"), "summary": ("summary",)},
        (("공고번호", ("bid_no", "notice_no")), ("요구년도", ("demand_year",)), ("발주기관", ("organization",)), ("계약방법", ("contract_method",)), ("입찰방법", ("bid_method",)),
         ("업무구분", ("business_type", "category")), ("등록마감", ("registration_deadline",)), ("입찰서제출마감", ("bid_submission_deadline",)), ("개찰일시", ("opening_datetime",))),
        {}, _d2b_bid,
    ),
    Source(
        NEWS, ARTICLE,
        {"organization": ("publisher", "organization"), "posted_at": ("pub_date", "posted_at"), "due_at": (), "amount": (), "region": (), "summary": ("summary",),
         "url": ("original_link", "url", "naver_link")},
        (), {}, _news,
    ),
)


def normalise(raw: DataFrame, as_of: Column, sources: tuple[Source, ...] = SOURCES) -> DataFrame:
    """Items of the raw records, in the schema of the item store, with links resolved and a content hash."""
    r = Reader(raw)
    name, kind = F.coalesce(r.one("source_name"), F.lit("")), F.coalesce(r.one("source_type"), F.lit(""))
    is_source = [(name == s.name) & ((kind == s.kind) if s.kind else F.lit(True)) for s in sources]

    def choose(make: Callable[[Source], Column], generic: Column) -> Column:
        out = F
        for hit, s in zip(is_source, sources):
            out = out.when(hit, make(s))
        return out.otherwise(generic)

    def value(c: str) -> Column:
        def of(s: Source) -> Column:
            found = r.first(*s.aliases.get(c, GENERIC[c]))
            return F.coalesce(found, F.lit(s.defaults[c])) if c in s.defaults else found

        return choose(of, r.first(*GENERIC[c]))

    def made_summary(s: Source) -> Column:
        own = r.first(*s.aliases.get("summary", GENERIC["summary"]))
        if not s.summary:
            return own
        parts = [F.concat(F.lit(f"{label}: "), F.coalesce(r.first(*names), F.lit("-"))) for label, names in s.summary]
        return F.coalesce(own, F.concat_ws("; ", *parts))

    words = matched_terms(r.joined(*SUMMARY_KEYWORD_FIELDS), T.KEYWORDS, T.VETOES)
    listed = F.coalesce(r.one("keywords"), F.nullif(F.array_join(words, ";"), F.lit("")))
    query = r.one("keyword_query")
    with_query = F.when(query.isNotNull() & (listed.isNull() | ~F.contains(listed, query)), F.concat_ws(";", listed, query)).otherwise(listed)
    generic_score = scoring.generic_relevance(r.one("relevance_score"), words)
    out = raw.select(
        choose(lambda s: F.lit(s.kind or BID), kind).alias("source_type"), name.alias("source_name"),
        *[(choose(made_summary, r.first(*GENERIC[c])) if c == "summary" else value(c)).alias(c) for c in GENERIC],
        F.when(name == NEWS, with_query).otherwise(listed).alias("keywords"), query.alias("keyword_query"),
        choose(lambda s: s.relevance(r, as_of) if s.relevance else generic_score, generic_score).alias("relevance_score"),
        r.first("operating_scope").alias("given_scope"), F.coalesce(r.one("is_known_important").try_cast("int"), F.lit(0)).alias("is_known_important"),
        F.coalesce(r.one("is_mock").try_cast("int"), F.lit(0)).alias("given_mock"), r.one("data_quality").alias("given_quality"),
        r.first(*DETAIL_URLS).alias("direct_url"), r.first("original_link", "originallink").alias("article_url"), r.first("naver_link", "link", "url").alias("article_link"),
        r.first(*RECORD_IDS).alias("record_id"), r.first(*RECORD_NOS).alias("record_no"), r.one("unique_hash").alias("given_hash"),
    )
    return _finished(out)


def _finished(df: DataFrame) -> DataFrame:
    """Parsed dates and amounts, sample flag, scope, links and hash."""
    quality = F.coalesce("given_quality", F.when(F.col("given_mock") == 1, "mock").otherwise("real"))
    mock = F.when(quality.isin("mock", "sample", "test"), 1).otherwise(F.col("given_mock"))
    goods = (F.col("source_name") == G2B) & (F.col("source_type") == BID) & F.coalesce(F.col("business_type"), F.lit("")).isin("물품", "용역") & any_term(F.col("title"), ["모듈러"])
    plan = F.col("source_type") == PLAN
    scope = F.coalesce(F.col("given_scope"), F.when(goods, "modular_goods_service").when(plan, "modular_procurement_plan"))
    url_is_portal = F.concat(F.regexp_replace(F.coalesce("direct_url", F.lit("")), "/+$", ""), F.lit("/")).isin(*PORTALS.values())
    news, g2b = F.col("source_name") == NEWS, F.col("source_name") == G2B
    direct = F.when(~news & ~g2b & (mock == 0) & ~url_is_portal, F.col("direct_url"))
    portal = F
    for name, url in PORTALS.items():
        portal = portal.when((F.col("source_name") == name) & (mock == 0), F.lit(url))
    names = F
    for name, shown in PORTAL_NAMES.items():
        names = names.when(F.col("source_name") == name, F.lit(shown))
    original = F.when(news, F.col("article_url")).otherwise(direct)
    search = F.when(news, F.col("article_link")).when(direct.isNull(), portal.otherwise(None))
    df = df.withColumns({
        "posted_at": dates.any_date("posted_at"), "due_at": dates.any_date("due_at"), "amount": numbers.amount("amount"), "data_quality": quality,
        "is_mock": mock.cast("int"), "operating_scope": scope, "is_operating_scope": scope.isNotNull().cast("int"), "original_url": original, "source_search_url": search,
        "link_type": F.when((mock == 1) & ~news, "mock").when(original.isNotNull(), "exact").otherwise("unknown"),
        "link_status": F.when(news | original.isNotNull() | (mock == 1), "unchecked").otherwise("unknown"),
        "source_record_id": F.when(news, F.coalesce("article_url", "article_link")).otherwise(F.col("record_id")), "source_record_no": F.when(~news, F.col("record_no")),
        "source_portal_name": names.otherwise(None),
    })
    df = df.withColumn("url", F.coalesce("url", "original_url", "source_search_url"))
    df = df.withColumn("unique_hash", F.coalesce("given_hash", item_hash()))
    return df.drop("given_scope", "given_mock", "given_quality", "direct_url", "article_url", "article_link", "record_id", "record_no", "given_hash")


def item_hash() -> Column:
    """Content identity of an item: by plan, by tender number, by article address, or by its content."""
    record = F.when(present("source_record_id") != "", F.col("source_record_id")).otherwise(F.col("bid_no"))
    plan = identity.business_hash("source_name", "source_type", record, "title", "organization", F.col("due_at").cast("string"))
    tender = identity.business_hash("source_type", F.lit(G2B), record, F.coalesce(F.nullif(F.col("source_record_no"), F.lit("")), F.col("bid_order")), "business_type")
    article = identity.business_hash("source_type", "source_name", "url")
    nameless = identity.business_hash("source_type", "source_name", "title", F.col("posted_at").cast("string"), "keyword_query")
    other = identity.business_hash("source_type", "source_name", "title", "organization", F.col("posted_at").cast("string"), "url")
    return (
        F.when(F.col("source_type") == PLAN, plan)
        .when((F.col("source_name") == G2B) & (present(record) != ""), tender)
        .when((F.col("source_type") == ARTICLE) & (present("url") != ""), article)
        .when(F.col("source_type") == ARTICLE, nameless)
        .otherwise(other)
    )
