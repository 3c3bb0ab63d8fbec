"""Queries of board pages and API answers, made from orders: a customer is a source, an order a page or an answer."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import boards
from ..sources import payloads
from .registry import query, table


def _pages(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    number = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    title = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("공모 &amp; "), F.col("o_orderpriority"))).otherwise(F.lit("계약 결과"))
    link = F.concat(F.lit('<table><tr><td>1</td><td><a class="x" href="/view?seq='), F.col("o_orderkey") % 9, F.lit('"><b>'), title, F.lit("</b></a></td></tr></table>"))
    poor = F.when(F.col("o_orderkey") % 7 == 0, "<table><tr><td>2<td>none<tr><th> <b>3</b> </th><td>none</td><tr><td>no<td>7").otherwise("")
    html = F.when(F.col("o_orderpriority") == "5-LOW", F.lit("<table></table>")).otherwise(F.concat(poor, link))
    status = F.when(F.col("o_orderkey") % 4 == 0, 500).otherwise(200)
    return o.select(F.col("o_custkey").alias("source"), number.alias("page_no"), status.alias("status"), html.alias("html"))


PAGES_SQL = """WITH p AS (SELECT o_custkey AS source, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page_no, o_orderkey % 4 <> 0 AS fine, o_orderkey % 7 = 0 AS poor,
  o_orderpriority = '5-LOW' AS bare, CAST(o_orderkey % 9 AS VARCHAR) AS record_id, CASE WHEN o_orderstatus = 'F' THEN '공모 & ' || o_orderpriority ELSE '계약 결과' END AS title FROM orders)"""


@query(PAGES_SQL + """, s AS (SELECT source, min(page_no) AS stop FROM p WHERE CASE WHEN page_no = 1 THEN NOT fine ELSE fine AND bare END GROUP BY 1),
f AS (SELECT source, record_id, arg_min(title, page_no) AS title FROM p LEFT JOIN s USING (source) WHERE fine AND NOT bare AND page_no < coalesce(stop, 1000000000) GROUP BY 1, 2)
SELECT source, record_id, title, '/view?seq=' || record_id AS href, false AS known FROM f WHERE contains(title, '공모')""")
def board_candidates(spark, sf_dir):
    return boards.candidates(boards.listed(_pages(spark, sf_dir), r"[?&]seq=(\d+)"), ["공모"])


@query(PAGES_SQL + """
SELECT source, page_no, CASE WHEN bare THEN 0 WHEN poor THEN 3 ELSE 1 END AS rows, CASE WHEN bare THEN 0 ELSE 1 END AS rows_with_title, CASE WHEN bare THEN 0.0::DOUBLE WHEN poor THEN 0.333::DOUBLE ELSE 1.0::DOUBLE END AS ratio,
  CASE WHEN bare THEN 'empty' WHEN poor THEN 'parser_mismatch' ELSE 'ok' END AS state, true AS table_found FROM p""")
def board_health(spark, sf_dir):
    return boards.list_health(_pages(spark, sf_dir)).drop("calls")


ANSWERS_SQL = """WITH a AS (SELECT o_custkey AS business, o_orderkey AS rank, o_orderkey, CASE o_orderkey % 6 WHEN 3 THEN 'AUTH' WHEN 4 THEN 'PARAM' WHEN 5 THEN 'PARSE' END AS error, CASE WHEN o_orderstatus = 'P' OR o_orderkey % 6 > 2 THEN 0 ELSE 1 END AS n FROM orders)"""


def _answers(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 6
    body = (
        F.when(k == 3, '{"response":{"header":{"resultCode":"30","resultMsg":"SERVICE KEY IS NOT REGISTERED"}}}')
        .when(k == 4, "<?xml version=\"1.0\"?><r><resultCode>11</resultCode><resultMsg>no</resultMsg></r>")
        .when(k == 5, "<r><resultCode>00</resultCode>")
        .when((F.col("o_orderstatus") == "P") & (k == 0), '{"response":{"header":{"resultCode":"00"},"body":{"items":[],"totalCount":0}}}')
        .when(F.col("o_orderstatus") == "P", "<r><resultCode>00</resultCode><items></items><totalCount>0</totalCount></r>")
        .when(k == 0, F.format_string('{"response":{"header":{"resultCode":"00"},"body":{"items":{"item":{"no":"%s"}},"totalCount":1}}}', "o_orderkey"))
        .when(k == 1, F.format_string('{"resultCode":0,"items":[{"no":"%s"}],"totalCount":"1"}', "o_orderkey"))
        .when(F.col("o_orderkey") % 4 == 0, F.format_string("<r><resultCode>00</resultCode><items><item id='3'><no type='x'><![CDATA[%s]]></no></item></items><totalCount>1</totalCount></r>", "o_orderkey"))
        .when(F.col("o_orderkey") % 24 == 2, F.format_string("<r><header><resultCode>00</resultCode></header><body><items><item><no>%s</no><sub><no>0</no></sub><e/></item></items><totalCount>1</totalCount></body></r>", "o_orderkey"))
        .otherwise(F.format_string("<n:r xmlns:n='u'><n:resultCode>00</n:resultCode><items><n:item><n:no> %s </n:no></n:item></items><totalCount>1</totalCount></n:r>", "o_orderkey"))
    )
    rows = o.select(F.col("o_custkey").alias("business"), F.col("o_orderkey").alias("rank"), F.col("o_orderkey").cast("string").alias("operation"), body.alias("body"))
    return payloads.unwrapped(rows)


@query(ANSWERS_SQL + """
SELECT rank, error, CAST(n AS BIGINT) AS total, CASE WHEN n = 1 THEN CAST(o_orderkey AS VARCHAR) ELSE '' END AS numbers FROM a""")
def payload_unwrap(spark, sf_dir):
    numbers = F.array_join(F.transform("items", lambda i: F.get_json_object(i, "$.no")), ",")
    return _answers(spark, sf_dir).select("rank", "error", "total", numbers.alias("numbers"))


@query(ANSWERS_SQL + """
SELECT business, CAST(min(CASE WHEN n = 1 THEN rank END) AS VARCHAR) AS used, CASE WHEN max(n) = 1 THEN 'rows' WHEN count(error) < count(*) THEN 'none' ELSE 'failed' END AS state, count(error) AS failed FROM a GROUP BY business""")
def operation_fallback(spark, sf_dir):
    return payloads.used_operations(_answers(spark, sf_dir))
