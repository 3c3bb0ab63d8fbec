"""Inclusion rules, set operations, reconciliation and run summaries.  Orders and events stand for items and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import aggregates, filters, joins, topk, windows
from ..plans import dashboard
from .registry import query, table


@query("""
SELECT user_id AS collector_name, CAST(sum(event_id % 5) AS BIGINT) AS inserted, CAST(sum(event_id % 3) AS BIGINT) AS updated, CAST(sum(event_id % 2) AS BIGINT) AS skipped,
  arg_max(s, (ts, event_id)) AS newest, max(ts) AS last_run,
  CASE WHEN bool_or(s = 'failed') AND NOT bool_or(s = 'success') THEN 'failed' WHEN bool_or(s = 'failed') THEN 'partial' ELSE 'success' END AS status
FROM (SELECT *, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS s FROM events) GROUP BY user_id""")
def collector_summary(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("collector_name"), F.col("ts").alias("started_at"),
        F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"),
        *[(F.col("event_id") % k).alias(c) for k, c in ((5, "inserted_count"), (3, "updated_count"), (2, "skipped_count"))],
    )
    return dashboard.collector_status(log)


@query("""
SELECT o_custkey, arg_min(o_orderkey, (o_orderpriority, -o_totalprice, o_orderkey)) AS representative, count(*) AS members FROM orders GROUP BY o_custkey""")
def representative_choice(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return windows.representatives(o, "o_custkey", "o_orderkey", [F.col("o_orderpriority"), -F.col("o_totalprice")])


@query("""
SELECT DISTINCT c_custkey FROM customer WHERE c_acctbal > 5000 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)""")
def favorites_added(spark, sf_dir):
    known = table(spark, sf_dir, "orders").where("o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey"))
    more = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select("c_custkey")
    return joins.add_missing(known, more, "c_custkey")


@query("""
SELECT user_id, event_id, 'GN-' || lpad(CAST(row_number() OVER (ORDER BY n DESC, user_id) AS VARCHAR), 4, '0') AS review_id
FROM (SELECT user_id, max(event_id) AS event_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 100)""")
def review_numbers(spark, sf_dir):
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.count(F.lit(1)).alias("n"))
    order = [F.desc("n"), F.asc("user_id")]
    return joins.numbered(users.orderBy(*order).limit(100), order, "review_id", "GN-%04d").drop("n")


@query("""
WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O')
SELECT k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'both' END AS side FROM a FULL JOIN b USING (k)""")
def set_operations(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a, b = (o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k")) for s in "FO")
    parts = ((b.subtract(a), "added"), (a.subtract(b), "removed"), (a.intersect(b), "both"))
    out = [df.withColumn("side", F.lit(side)) for df, side in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("""
SELECT DISTINCT o_custkey, count(*) AS before FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01'
AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01') GROUP BY o_custkey""")
def vanished_groups(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    old, new = (o.where(f"o_orderdate {sign} TIMESTAMP '1999-01-01'") for sign in ("<", ">="))
    return joins.vanished(old, new, "o_custkey")


@query("""
WITH a AS (SELECT o_custkey AS k, count(*) AS stored FROM orders GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS published FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
SELECT k, stored, coalesce(published, 0) AS published,
  CASE WHEN published IS NULL THEN 'all_filtered' WHEN published < stored / 2.0 THEN 'mostly_filtered' WHEN published < stored THEN 'some_filtered' ELSE 'complete' END AS decision
FROM a LEFT JOIN b USING (k)""")
def reconciliation(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "k")
    return aggregates.reconciled(o, "k", F.col("o_orderstatus") != "P")


@query("""
SELECT n_nationkey, n_name, regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') IN ('unitedkingdom', 'uk', 'nation3', 'nation7', 'canada') AS matches FROM nation""")
def country_match(spark, sf_dir):
    names = ("United Kingdom", "U.K.", "Nation-3", "NATION_7", "Canada")
    return table(spark, sf_dir, "nation").select("n_nationkey", "n_name", text.named_among("n_name", names).alias("matches"))


@query("""
SELECT doc_id, (contains(t, 'house') OR contains(t, 'haus')) AND (contains(t, 'license') OR contains(t, 'the')) AS matches
FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)""")
def two_sided_keyword_rule(spark, sf_dir):
    hit = text.any_term("text", ["house", "haus"]) & text.any_term("text", ["license", "the"])
    return table(spark, sf_dir, "documents").select("doc_id", hit.alias("matches"))


@query("""
SELECT o_orderkey, o_orderdate FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS o_orderdate FROM orders)
WHERE o_orderdate IS NULL OR CAST(o_orderdate AS DATE) >= DATE '2000-08-02'""")
def lookback_null_passes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("o_orderdate"))
    return o.where(filters.since("o_orderdate", F.lit("2000-08-02").cast("date")))


@query("""
SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS active, count(*) FILTER (o_orderstatus = 'F') AS closed, count(*) FILTER (o_orderstatus NOT IN ('O', 'F')) AS unknown,
  count(*) FILTER (o_orderstatus = 'O' AND o_orderpriority = '1-URGENT') AS urgent FROM orders""")
def summary_counts(spark, sf_dir):
    status = F.col("o_orderstatus")
    return aggregates.kpis(table(spark, sf_dir, "orders"), {
        "active": status == "O", "closed": status == "F", "unknown": ~status.isin("O", "F"),
        "urgent": (status == "O") & (F.col("o_orderpriority") == "1-URGENT"),
    })


@query("""
SELECT count(l_shipdate) AS shipped, CAST(max(greatest(l_shipdate, o_orderdate)) AS DATE) AS latest, count(DISTINCT o_custkey) AS customers
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def latest_over_two_fields(spark, sf_dir):
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    both = li.join(o, li.l_orderkey == o.o_orderkey).select("l_shipdate", "o_orderdate", "o_custkey")
    return both.agg(
        F.count("l_shipdate").alias("shipped"), F.to_date(F.max(F.greatest("l_shipdate", "o_orderdate"))).alias("latest"),
        F.count_distinct("o_custkey").alias("customers"),
    )


@query("""
SELECT o_orderkey, CASE WHEN n > 0 THEN 'D-' || n WHEN n = 0 THEN 'D-Day' ELSE 'D+' || -n END AS label
FROM (SELECT o_orderkey, date_diff('day', DATE '1998-06-01', CAST(o_orderdate AS DATE)) AS n FROM orders)""")
def deadline_label(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", dates.day_label(F.to_date("o_orderdate"), F.lit("1998-06-01").cast("date")).alias("label"))


@query("""
SELECT doc_id, contains(lower(coalesce(lang, '') || ' ' || coalesce(text, '')), 'de ') OR contains(lower(coalesce(lang, '') || ' ' || coalesce(text, '')), 'apache') AS mentioned FROM documents""")
def competitor_mentions(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.mentions(["lang", "text"], ["DE ", "Apache", " "]).alias("mentioned"))


@query("""
SELECT user_id, checked FROM (SELECT user_id, max(CASE WHEN event_type = 'view' THEN ts END) AS checked FROM events GROUP BY user_id)
ORDER BY checked ASC NULLS FIRST, user_id DESC LIMIT 50""")
def link_check_queue(spark, sf_dir):
    seen = F.max(F.when(F.col("event_type") == "view", F.col("ts"))).alias("checked")
    return topk.oldest_checked(table(spark, sf_dir, "events").groupBy("user_id").agg(seen), "checked", "user_id", 50)
