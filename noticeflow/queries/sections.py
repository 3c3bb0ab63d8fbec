"""Queries of the dashboard's sections and pages, and of API answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sections
from ..sources import payloads
from .registry import query, table

#: Items made from events: kinds by number, texts with and without the words that count.
ITEMS_SQL = """WITH i AS (SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN 'bid' WHEN 1 THEN '뉴스' WHEN 2 THEN 'rnd' WHEN 3 THEN 'patent' WHEN 4 THEN 'rnd' END AS source_type,
  CASE event_id % 5 WHEN 0 THEN '연구 공고' WHEN 1 THEN NULL WHEN 2 THEN '지원 결과' ELSE event_type || ' B66C' END AS summary, CASE event_id % 7 WHEN 0 THEN NULL ELSE '모듈 러 ' || event_type END AS title, ts, user_id, event_type FROM events)"""


def _items(spark, sf_dir):
    k = F.col("event_id")
    kind = F.when(k % 6 == 0, "bid").when(k % 6 == 1, "뉴스").when(k % 6 == 2, "rnd").when(k % 6 == 3, "patent").when(k % 6 == 4, "rnd")
    summary = F.when(k % 5 == 0, "연구 공고").when(k % 5 == 1, None).when(k % 5 == 2, "지원 결과").otherwise(F.concat("event_type", F.lit(" B66C")))
    title = F.when(k % 7 != 0, F.concat(F.lit("모듈 러 "), F.col("event_type")))
    return table(spark, sf_dir, "events").select(k.alias("id"), kind.alias("source_type"), summary.alias("summary"), title.alias("title"), F.lit(None).cast("string").alias("keywords"), "ts", "user_id", "event_type")


@query(ITEMS_SQL + """, s AS (SELECT *, coalesce(regexp_matches(summary, '공고|지원|사업'), false) AS call FROM i)
SELECT id, CASE WHEN source_type = 'bid' THEN 'bid' WHEN source_type = '뉴스' THEN 'news' WHEN source_type = 'patent' THEN 'patent' WHEN source_type = 'rnd' AND call THEN 'rnd-announce' WHEN source_type = 'rnd' THEN 'rnd-outcome' ELSE 'none' END AS section,
  contains(replace(lower(coalesce(title, '')), ' ', ''), '모듈러') AS modular FROM s""")
def section_filters(spark, sf_dir):
    out = F
    for name in ("bid", "news", "patent", "rnd-announce", "rnd-outcome"):
        out = out.when(sections.in_section(name), name)
    return _items(spark, sf_dir).select("id", out.otherwise("none").alias("section"), sections.modular("title").alias("modular"))


@query(ITEMS_SQL + """
SELECT id FROM i WHERE source_type = '뉴스' AND contains(lower(coalesce(title, '') || ' ' || coalesce(summary, '')), 'c') AND NOT contains(lower(coalesce(title, '') || ' ' || coalesce(summary, '')), 'b66')
UNION ALL SELECT id FROM i WHERE source_type = 'patent' AND contains(lower(coalesce(summary, '')), 'b66c')
UNION ALL SELECT id FROM i WHERE source_type = 'bid' AND ts >= TIMESTAMP '2024-01-15'""")
def refined_sections(spark, sf_dir):
    i = _items(spark, sf_dir).withColumn("due_at", F.col("ts"))
    own = lambda name, **how: sections.refined(i.where(sections.in_section(name)), name, **how).select("id")
    news = own("news", include=" C ", exclude="b66")
    return news.unionByName(own("patent", ipc="b66c")).unionByName(own("bid", open_from=F.lit("2024-01-15").cast("timestamp_ntz")))


@query(ITEMS_SQL + """, f AS (SELECT * FROM i WHERE source_type = 'rnd' ORDER BY ts DESC, id LIMIT 80)
SELECT id, title, summary FROM f WHERE contains(CASE WHEN coalesce(summary, '') <> '' THEN summary ELSE coalesce(title, '') END, '공고') ORDER BY ts DESC, id LIMIT 40""")
def research_calls(spark, sf_dir):
    return sections.announcements(_items(spark, sf_dir), [F.desc("ts"), F.asc("id")], 40).select("id", "title", "summary")


@query(ITEMS_SQL + """
SELECT id, coalesce(source_type = 'rnd', false) AND user_id = 7 AS business, (coalesce(event_type = 'click', false) OR coalesce(source_type = 'click', false)) AND ts >= TIMESTAMP '2024-01-20' - INTERVAL 7 DAY
  AND contains(lower(concat_ws(' ', coalesce(title, ''), event_type, coalesce(source_type, ''), coalesce(summary, ''))), 'click') AS news FROM i""")
def page_filters(spark, sf_dir):
    i = _items(spark, sf_dir).withColumns({"agency": F.col("user_id").cast("string"), "status": F.lit("active"), "media": F.col("event_type"), "source": F.col("source_type"), "published_at": F.col("ts")})
    now = F.lit("2024-01-20").cast("timestamp_ntz")
    return i.select("id", sections.business_page("rnd", "7", "active").alias("business"), sections.news_page("click", 7, now, "click").alias("news"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 OR v = 0 THEN '-' WHEN v >= 100000000 THEN format('{:.1f}억 원', v / 100000000) ELSE format('{:,}', v) || '원' END AS shown
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN CAST(floor(o_totalprice) AS BIGINT) * 1000 WHEN o_orderkey % 4 = 1 THEN 0 ELSE CAST(floor(o_totalprice) AS BIGINT) END AS v FROM orders)""")
def amount_display(spark, sf_dir):
    k, v = F.col("o_orderkey"), F.floor("o_totalprice")
    amount = F.when(k % 9 == 0, None).when(k % 4 == 0, v * 1000).when(k % 4 == 1, 0).otherwise(v)
    return table(spark, sf_dir, "orders").select("o_orderkey", sections.amount_shown(amount).alias("shown"))


@query("""
SELECT event_id, CASE event_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS total, CASE event_id % 5 WHEN 0 THEN event_type || ';b' WHEN 1 THEN event_type ELSE '' END AS names,
  CASE event_id % 5 WHEN 2 THEN 'AUTH_ERROR: 30 SERVICE KEY IS NOT REGISTERED' WHEN 3 THEN 'PARAM_ERROR: 99 필수 값' WHEN 4 THEN 'API_ERROR: 500 down' END AS error FROM events""")
def api_answers(spark, sf_dir):
    k, t = F.col("event_id") % 5, F.col("event_type")
    body = lambda a, b: F.concat(F.lit(a), t, F.lit(b))
    answer = (
        F.when(k == 0, body('{"response":{"header":{"resultCode":"00"},"body":{"totalCount":2,"items":[{"n":"', '"},{"n":"b"}]}}}'))
        .when(k == 1, body('{"response":{"header":{"resultCode":"7","resultMsg":"normal service."},"body":{"totalCount":"1","items":{"item":{"n":"', '"}}}}}'))
        .when(k == 2, '{"response":{"header":{"resultCode":"30","resultMsg":"SERVICE KEY IS NOT REGISTERED"}}}')
        .when(k == 3, '{"resultCode":"99","resultMag":"필수 값"}')
        .otherwise('{"header":{"resultCode":500,"resultMsg":"down"},"body":{}}')
    )
    read = payloads.unwrapped(table(spark, sf_dir, "events").select("event_id", answer.alias("body")))
    names = sections.joined_values(F.transform("items", lambda x: F.get_json_object(x, "$.n")))
    error = F.when(F.col("error").isNotNull(), F.concat("error", F.lit("_ERROR: "), "code", F.lit(" "), "message"))
    return read.select("event_id", F.col("total").cast("int").alias("total"), names.alias("names"), error.alias("error"))


@query("""
SELECT event_id, event_type, CASE WHEN event_id % 5 <> 0 THEN ts END AS ts FROM events
ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 99 END, CASE WHEN event_id % 5 <> 0 THEN ts END ASC NULLS LAST, lpad(CAST(event_id AS VARCHAR), 9, '0')""")
def candidate_order(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.when(F.col("event_id") % 5 != 0, F.col("ts")).alias("ts"))
    e = e.withColumn("key", F.lpad(F.col("event_id").cast("string"), 9, "0"))
    return sections.by_class(e, ["purchase", "click"], "event_type", "ts", "key").drop("key")
