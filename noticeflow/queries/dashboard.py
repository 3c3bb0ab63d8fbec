"""Dashboard queries: KPIs, filters, orders, trends, buckets.  Events and orders stand for items."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..operators import aggregates, filters, topk
from .registry import query, table

AS_OF_EVENTS, AS_OF_ORDERS = date(2024, 1, 31), date(2001, 8, 2)


@query("""
SELECT count(*) AS total,
       count(*) FILTER (o_orderdate >= TIMESTAMP '2001-08-01') AS new_24h,
       count(*) FILTER (o_orderstatus = 'O') AS open,
       count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent,
       count(*) FILTER (CAST(o_orderdate AS DATE) BETWEEN DATE '2001-08-02' AND DATE '2001-08-09') AS due_soon,
       count(*) FILTER (o_totalprice >= 300000) AS high_value
FROM orders""")
def kpi_block(spark, sf_dir):
    day = F.lit(AS_OF_ORDERS)
    o = table(spark, sf_dir, "orders")
    return aggregates.kpis(o, {
        "new_24h": F.col("o_orderdate") >= F.date_sub(day, 1).cast("timestamp"),
        "open": F.col("o_orderstatus") == "O",
        "urgent": F.col("o_orderpriority") == "1-URGENT",
        "due_soon": F.to_date("o_orderdate").between(day, F.date_add(day, 7)),
        "high_value": F.col("o_totalprice") >= 300000,
    })


ITEMS_SQL = """
  SELECT o_orderkey, o_orderdate, o_orderstatus, o_totalprice, o_orderpriority, c_name, c_mktsegment, n_name
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""


def order_items(spark, sf_dir):
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    out = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return out.select("o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice", "o_orderpriority", "c_name", "c_mktsegment", "n_name")


@query(f"""
SELECT * FROM ({ITEMS_SQL})
WHERE o_orderstatus IN ('O', 'P') AND o_totalprice >= 100000
  AND (c_mktsegment IS NULL OR c_mktsegment = '' OR c_mktsegment IN ('BUILDING', 'MACHINERY'))
  AND NOT contains(coalesce(o_orderpriority, ''), 'LOW')
  AND CAST(o_orderdate AS DATE) >= DATE '1996-01-01' AND CAST(o_orderdate AS DATE) <= DATE '2000-12-31'""")
def composite_filter(spark, sf_dir):
    wanted = filters.ItemFilter(
        one_of={"o_orderstatus": ["O", "P"]}, at_least={"o_totalprice": 100000},
        one_of_or_blank={"c_mktsegment": ["BUILDING", "MACHINERY"]}, without={"o_orderpriority": ["LOW"]},
        between={"o_orderdate": (date(1996, 1, 1), date(2000, 12, 31))},
    )
    return filters.filter_items(order_items(spark, sf_dir), wanted)


@query(f"""
SELECT * FROM ({ITEMS_SQL})
WHERE contains(lower(concat_ws(' ', coalesce(c_name, ''), coalesce(n_name, ''), coalesce(c_mktsegment, ''))), '_1 build')""")
def search_multi_column(spark, sf_dir):
    wanted = filters.ItemFilter(search="_1 BUILD", search_columns=("c_name", "n_name", "c_mktsegment"))
    return filters.filter_items(order_items(spark, sf_dir), wanted)


@query("""
SELECT p_partkey, p_name, p_brand, p_size FROM part
WHERE p_brand <> (SELECT min(p_brand) FROM part) OR p_size >= 25 OR p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)""")
def scope_filter_union_back(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    first = part.agg(F.min("p_brand").alias("first_brand"))
    tracked = table(spark, sf_dir, "lineitem").where("l_quantity >= 50").select(F.col("l_partkey").alias("p_partkey"))
    marked = part.join(F.broadcast(first))  # one row
    out = filters.scoped(marked, F.col("p_size") >= 25, F.col("p_brand") == F.col("first_brand"), tracked, "p_partkey")
    return out.drop("first_brand")


@query("""
SELECT o_orderkey, o_totalprice, o_orderdate,
       20 * CAST(CAST(o_orderdate AS DATE) BETWEEN DATE '2001-07-26' AND DATE '2001-08-02' AS INT) + 10 * CAST(o_totalprice >= 300000 AS INT)
       + 8 * CAST(o_orderpriority = '1-URGENT' AS INT) + round(o_totalprice / 100000, 2) AS priority
FROM orders
WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '2001-07-26' AND DATE '2001-08-02' OR o_totalprice >= 300000 OR o_orderpriority = '1-URGENT'
ORDER BY priority DESC, o_orderdate DESC NULLS LAST, o_orderkey LIMIT 12""")
def priority_topk(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    day = F.lit(AS_OF_ORDERS)
    marks = [
        (F.to_date("o_orderdate").between(F.date_sub(day, 7), day), 20), (F.col("o_totalprice") >= 300000, 10),
        (F.col("o_orderpriority") == "1-URGENT", 8),
    ]
    out = topk.priority(o, marks, F.round(F.col("o_totalprice") / 100000, 2), "o_orderdate", "o_orderkey")
    return out.drop("o_orderpriority")


@query("""
SELECT o_orderkey, o_totalprice, o_orderdate FROM orders
ORDER BY o_totalprice DESC NULLS LAST, o_orderdate DESC NULLS LAST, o_orderkey LIMIT 50""")
def ordered_by_score(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    return topk.ordered(o, "score", "o_orderkey", posted="o_orderdate", score="o_totalprice").limit(50)


@query("""
WITH s AS (SELECT o_orderkey, o_orderdate, CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'closed' ELSE 'unknown' END AS status FROM orders)
SELECT * FROM s ORDER BY CASE status WHEN 'active' THEN 0 WHEN 'unknown' THEN 1 ELSE 2 END,
  CASE WHEN status = 'active' THEN o_orderdate END ASC NULLS LAST, CASE WHEN status = 'closed' THEN o_orderdate END DESC NULLS LAST,
  CASE WHEN status = 'unknown' THEN o_orderdate END DESC NULLS LAST, o_orderkey""")
def ordered_by_status(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "F", "closed").otherwise("unknown")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", status.alias("status"))
    return topk.by_status(o, "status", "o_orderdate", "o_orderdate", "o_orderkey")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 12")
def counts_topn(spark, sf_dir):
    return aggregates.top_counts(table(spark, sf_dir, "events"), "event_type", 12)


@query("""
SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events
WHERE CAST(ts AS DATE) > DATE '2024-01-31' - 14 AND CAST(ts AS DATE) <= DATE '2024-01-31' GROUP BY 1""")
def daily_trend(spark, sf_dir):
    return aggregates.daily_trend(table(spark, sf_dir, "events"), "ts", F.lit(AS_OF_EVENTS), 14)


@query("""
WITH b(place, bucket, low, high) AS (VALUES (0, '0', -0.1, 0), (1, 'low', 0, 4), (2, 'middle', 4, 7.99), (3, 'high', 7.99, 100), (4, 'none', 100000, 100001))
SELECT place, bucket, count(value) AS n FROM b LEFT JOIN events ON value > low AND value <= high GROUP BY place, bucket""")
def bucket_histogram(spark, sf_dir):
    edges = [("0", -0.1, 0.0), ("low", 0.0, 4.0), ("middle", 4.0, 7.99), ("high", 7.99, 100.0), ("none", 100000.0, 100001.0)]
    return aggregates.histogram(table(spark, sf_dir, "events"), "value", edges)


@query("""
SELECT trim(token) AS token, count(*) AS n FROM (SELECT unnest(string_split(coalesce(text, ''), ' ')) AS token FROM conversations)
WHERE trim(token) <> '' GROUP BY 1 ORDER BY n DESC, token LIMIT 30""")
def token_frequency(spark, sf_dir):
    return aggregates.token_counts(table(spark, sf_dir, "conversations"), F.col("text"), " ", 30)


@query("""
SELECT list_sort(list(DISTINCT event_type)) AS event_type, min(CAST(ts AS DATE)) AS first_day, max(CAST(ts AS DATE)) AS last_day FROM events""")
def facet_values(spark, sf_dir):
    return aggregates.facets(table(spark, sf_dir, "events"), ["event_type"], "ts")


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k, count(*) OVER (PARTITION BY user_id) AS runs FROM events)
SELECT user_id, event_type AS status, ts AS at, CAST(runs AS BIGINT) AS runs FROM r WHERE k = 1""")
def newest_status(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("status"), F.col("ts").alias("at"), "event_id")
    return aggregates.newest_status(e, "user_id", ["at", "event_id"], ["status", "at"])


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus <> 'F' OR o_totalprice >= 50000 OR o_orderstatus IS NULL")
def predicated_delete(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return filters.delete_where(o, (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") < 50000)).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value, event_type FROM events")
def predicated_update(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "value", "event_type")
    return filters.update_where(e, F.col("event_type") == "error", {"value": F.lit(None).cast("double")})
