"""Queries of the item normalisers and the public export, over raw records made from orders."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions import terms as T
from ..operators import topk
from ..plans import export, items
from .registry import query, table

AS_OF = date(2000, 1, 1)
#: Titles of the raw records, by the order's number.
TITLES = ("학교 모듈러 임대", "도로 포장", "모듈러 기숙사 신축", "장난감 모듈러", "OSC 공업화주택", "모듈러 교실 구매", "청사 청소 용역")
TITLE_SQL = "CASE o_orderkey % 7 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TITLES)) + " END"
HASH_SQL = "sha256(concat_ws('|', {}))"


def _title():
    return F.element_at(F.array(*map(F.lit, TITLES)), (F.col("o_orderkey") % len(TITLES) + 1).cast("int"))


def _terms(text: str, words) -> str:
    """How many of the words a text holds, each listing counted, in SQL."""
    return "(" + " + ".join(f"CAST(contains(lower({text}), '{w.lower()}') AS INT)" for w in words) + ")"


def _any(text: str, words) -> str:
    return f"({_terms(text, words)} > 0)"


def _raw(spark, sf_dir, source: str, kind: str | None, **more):
    o = table(spark, sf_dir, "orders")
    known = {
        "source_name": F.lit(source), "source_type": F.lit(kind).cast("string"), "title": _title(), "posted_at": F.date_format("o_orderdate", "yyyy.MM.dd"),
        "organization": F.when(F.col("o_orderkey") % 4 != 0, F.concat(F.lit("Org "), F.col("o_custkey").cast("string"))),
        "amount": F.when(F.col("o_orderkey") % 3 != 0, F.format_number(F.floor("o_totalprice"), 0)),
    }
    return o.select("o_orderkey", *[c.alias(n) for n, c in (known | more).items()])


RAW_SQL = f"""WITH o AS (SELECT *, {TITLE_SQL} AS title, CASE WHEN o_orderkey % 4 <> 0 THEN 'Org ' || o_custkey END AS org, CAST(o_orderdate AS DATE) AS posted,
  CASE WHEN o_orderkey % 3 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) END AS amount, format('{{:,}}', CAST(floor(o_totalprice) AS BIGINT)) AS shown FROM orders)"""


@query(RAW_SQL + f""", p AS (SELECT *, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(date_trunc('month', o_orderdate) AS DATE) END AS due FROM o)
SELECT '{items.PLAN}' AS source_type, title, org AS organization, posted AS posted_at, due AS due_at, amount, 'P' || o_orderkey AS bid_no, '발주계획' AS business_subtype,
  'modular_procurement_plan' AS operating_scope, 1 AS is_operating_scope, '{items.PORTALS[items.G2B]}' AS url, 'unknown' AS link_type,
  concat_ws('; ', '발주계획번호: P' || o_orderkey, '발주예정: ' || coalesce(strftime(due, '%Y%m'), '-'), '업무구분: -', '계약방법: -', '입찰방법: -', '발주기관: ' || coalesce(org, '-'), '수요기관: -',
    '예산액: ' || CASE WHEN amount IS NULL THEN '-' ELSE shown END) AS summary,
  {HASH_SQL.format("'" + items.G2B + "', '" + items.PLAN + "', 'p' || o_orderkey, lower(title), lower(coalesce(org, '')), coalesce(CAST(due AS VARCHAR), '')")} AS unique_hash FROM p""")
def normalise_plans(spark, sf_dir):
    raw = _raw(spark, sf_dir, items.G2B, items.PLAN, plan_no=F.concat(F.lit("P"), F.col("o_orderkey").cast("string")), due_at=F.when(F.col("o_orderkey") % 5 != 0, F.date_format("o_orderdate", "yyyyMM")))
    return items.normalise(raw, F.lit(AS_OF)).select(
        "source_type", "title", "organization", "posted_at", "due_at", "amount", "bid_no", "business_subtype", "operating_scope", "is_operating_scope", "url", "link_type", "summary", "unique_hash"
    )


@query(RAW_SQL + f""", t AS (SELECT *, CASE WHEN o_orderstatus = 'O' THEN '물품' WHEN o_orderstatus = 'P' THEN '용역' ELSE '공사' END AS kind, CASE WHEN o_orderkey % 6 <> 0 THEN 'R' || o_orderkey END AS no FROM o)
SELECT '{items.BID}' AS source_type, title, org AS organization, posted AS posted_at, amount, no AS bid_no, '00' AS bid_order, kind AS business_type,
  CASE WHEN kind <> '공사' AND contains(title, '모듈러') THEN 'modular_goods_service' END AS operating_scope,
  CAST(least(100, 5 * {_terms("title", T.KEYWORDS)} + CASE WHEN {_any("coalesce(org, '')", T.ORGANISATIONS)} THEN 2 ELSE 0 END + CASE WHEN {_any("title", T.DIRECT)} THEN 5 ELSE 0 END) AS DOUBLE) AS relevance_score,
  CASE WHEN no IS NOT NULL THEN {HASH_SQL.format("'" + items.BID + "', '" + items.G2B + "', lower(no), '00', kind")}
    ELSE {HASH_SQL.format("'" + items.BID + "', '" + items.G2B + "', lower(title), lower(coalesce(org, '')), CAST(posted AS VARCHAR), '" + items.PORTALS[items.G2B] + "'")} END AS unique_hash FROM t""")
def normalise_tenders(spark, sf_dir):
    kind = F.when(F.col("o_orderstatus") == "O", "물품").when(F.col("o_orderstatus") == "P", "용역").otherwise("공사")
    number = F.when(F.col("o_orderkey") % 6 != 0, F.concat(F.lit("R"), F.col("o_orderkey").cast("string")))
    raw = _raw(spark, sf_dir, items.G2B, None, category=kind, bidNtceNo=number, bidNtceOrd=F.lit("00"))
    return items.normalise(raw, F.lit(AS_OF)).select(
        "source_type", "title", "organization", "posted_at", "amount", "bid_no", "bid_order", "business_type", "operating_scope", "relevance_score", "unique_hash"
    )


@query(RAW_SQL + f"""
SELECT title, coalesce(org, '한국토지주택공사') AS organization, amount, posted AS posted_at,
  concat_ws('; ', '공고번호: L' || o_orderkey, '담당지역: -', '추정가격: -', '기초금액: -', '계약유형: -') AS summary,
  CAST(least(100, CASE WHEN {_any("title", T.DIRECT)} THEN 10 ELSE 0 END + CASE WHEN {_any("title", T.HOUSING_CONTEXT)} THEN 5 ELSE 0 END
    + CASE WHEN {_any("coalesce(org, '')", ("lh", "한국토지주택공사", "본사"))} THEN 2 ELSE 0 END + CASE WHEN amount IS NOT NULL THEN 1 ELSE 0 END) AS DOUBLE) AS relevance_score
FROM o""")
def normalise_housing(spark, sf_dir):
    raw = _raw(spark, sf_dir, items.LH, items.BID, bid_no=F.concat(F.lit("L"), F.col("o_orderkey").cast("string")))
    return items.normalise(raw, F.lit(AS_OF)).select("title", "organization", "amount", "posted_at", "summary", "relevance_score")


#: The old export holds orders before 2000, the fresh one those that are open, twice where a later row fills a gap.
EXPORT_SQL = """WITH e AS (SELECT o_orderkey AS id, o_custkey AS bid_no, o_orderkey AS bid_order, o_orderpriority AS title, o_orderstatus AS organization, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS posted_at
  FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01' AND o_orderkey % 50 <> 7),
f AS (SELECT o_custkey AS bid_no, o_orderkey AS bid_order, CASE WHEN o_orderkey % 3 = 0 THEN 'late' ELSE 'early' END AS title, CASE WHEN o_orderkey % 5 <> 0 THEN 'fresh' END AS organization,
  CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS posted_at FROM orders WHERE o_orderstatus IN ('O', 'P')),
m AS (SELECT e.id, coalesce(e.bid_no, f.bid_no) AS bid_no, coalesce(e.bid_order, f.bid_order) AS bid_order, coalesce(f.title, e.title) AS title, coalesce(f.organization, e.organization) AS organization,
  coalesce(f.posted_at, e.posted_at) AS posted_at FROM e FULL JOIN f ON e.bid_no = f.bid_no AND e.bid_order = f.bid_order),
t AS (SELECT coalesce(max(id), 0) AS top FROM m)"""


@query(EXPORT_SQL + """
SELECT CAST(CASE WHEN id IS NOT NULL THEN id ELSE top + row_number() OVER (PARTITION BY id IS NULL ORDER BY 'bid' || chr(31) || 's' || chr(31) || bid_no || chr(31) || bid_order) END AS VARCHAR) AS id,
  CAST(bid_no AS VARCHAR) AS bid_no, CAST(bid_order AS VARCHAR) AS bid_order, title, organization, posted_at FROM m, t""")
def export_merge(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    text = lambda c: F.col(c).cast("string")
    base = [F.lit("S").alias("source_name"), F.lit(items.BID).alias("source_type"), text("o_custkey").alias("bid_no"), text("o_orderkey").alias("bid_order"), F.to_date("o_orderdate").cast("string").alias("posted_at")]
    key = F.col("o_orderkey")
    old = o.where("o_orderdate < TIMESTAMP '2000-01-01'").select(text("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("organization"), *base, key.alias("ord"))
    live = o.where("o_orderstatus IN ('O', 'P')")
    none, fresh = F.lit(None).cast("string").alias("id"), F.when(key % 5 != 0, "fresh").alias("organization")
    first = live.select(none, F.lit("early").alias("title"), fresh, *base, (key * 2).alias("ord"))
    second = live.where("o_orderkey % 3 = 0").select(none, F.lit("late").alias("title"), F.lit(" ").alias("organization"), *base, (key * 2 + 1).alias("ord"))
    allowed = old.where("ord % 50 = 7").select("id", F.lit("withdrawn").alias("reason")).unionByName(old.where("ord % 50 = 8").select("id", F.lit(" ").alias("reason")))
    return export.merge_export(old, first.unionByName(second), allowed, "business").select("id", "bid_no", "bid_order", "title", "organization", "posted_at")


@query(RAW_SQL + """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus = 'O' ELSE o_orderkey % 10 = 0 OR contains(replace(lower(title), ' ', ''), '모듈러') OR contains(replace(lower(title), ' ', ''), 'osc') END AS public FROM o""")
def public_inclusion(spark, sf_dir):
    kind = F.when(F.col("o_orderkey") % 3 == 0, export.CONTEST).otherwise(items.BID)
    stage = F.when(F.col("o_orderstatus") == "O", T.OPEN_STAGES[0]).otherwise("closed")
    o = table(spark, sf_dir, "orders").select("o_orderkey", kind.alias("source_type"), stage.alias("notice_status"), _title().alias("title"), F.lit(None).cast("string").alias("original_url"))
    return o.select("o_orderkey", export.included(o, F.col("o_orderkey") % 10 == 0).alias("public"))


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate ASC NULLS LAST, o_totalprice DESC, o_orderkey LIMIT 50")
def ordered_by_due(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return topk.ordered(o, "due", "o_orderkey", due="o_orderdate", score="o_totalprice").limit(50)
