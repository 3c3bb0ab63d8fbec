"""Profiles, distributions, duplicates and conservation of counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls
from ..operators import aggregates
from .normalising import KEPT_SQL, PARTS_SQL, TRACK_SQL
from .registry import query, table


@query("""
SELECT event_type, count(*) AS n, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (), 4) AS share,
  round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (), 4) >= 0.3 AS skewed FROM events GROUP BY event_type""")
def distribution_with_skew(spark, sf_dir):
    return aggregates.distribution(table(spark, sf_dir, "events"), "event_type", 0.3)


CANONICAL_SQL = PARTS_SQL + f""", q AS (SELECT *, array_to_string(list_sort({KEPT_SQL.format(TRACK_SQL)}), '&') AS kept FROM p),
c AS (SELECT page_id, u AS url, host, CASE WHEN scheme = '' THEN 'https' ELSE scheme END || '://' || host || regexp_replace(path, '/+$', '') || CASE WHEN kept = '' THEN '' ELSE '?' || kept END AS canonical FROM q)"""


@query(CANONICAL_SQL + """
SELECT CAST(count(url) - count(DISTINCT url) AS BIGINT) AS same_url, CAST(count(canonical) - count(DISTINCT canonical) AS BIGINT) AS same_canonical, CAST(count(host) - count(DISTINCT host) AS BIGINT) AS same_host FROM c""")
def dedup_metrics(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("url", urls.canonical("url").alias("canonical"))
    host = F.lower(F.regexp_extract(F.trim("url"), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://([^/?#]*))?", 1))
    return aggregates.duplicate_counts(p, {"same_url": F.trim("url"), "same_canonical": F.col("canonical"), "same_host": host})


@query("""
WITH t AS (SELECT sha256(text) AS key, source FROM documents WHERE text IS NOT NULL)
SELECT key, count(DISTINCT source) AS groups, CAST(count(*) AS BIGINT) AS rows FROM t GROUP BY key HAVING count(DISTINCT source) >= 2""")
def cross_group_duplicates(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null").select(F.sha2("text", 256).alias("key"), "source")
    return aggregates.keys_in_several(d, "key", "source")


@query("""
WITH c AS (SELECT count(*) AS total, count(*) FILTER (url LIKE 'https:%') AS secure, count(*) FILTER (url LIKE 'http:%') AS plain, count(*) FILTER (url IS NULL) AS missing, count(DISTINCT url) AS urls FROM pages)
SELECT *, total = secure + plain + missing AS by_scheme, urls <= total AS by_url, total = secure + plain + missing AND urls <= total AS all_hold FROM c""")
def metric_conservation(spark, sf_dir):
    totals = table(spark, sf_dir, "pages").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.startswith("url", F.lit("https:"))).alias("secure"),
        F.count_if(F.startswith("url", F.lit("http:"))).alias("plain"), F.count_if(F.col("url").isNull()).alias("missing"), F.count_distinct("url").alias("urls"),
    )
    return aggregates.conserved(totals, {
        "by_scheme": F.col("total") == F.col("secure") + F.col("plain") + F.col("missing"), "by_url": F.col("urls") <= F.col("total"),
    })


@query("""
WITH r AS (SELECT unnest(list_filter([CASE WHEN n_chars < 100 THEN 'short' END, CASE WHEN contains(text, '$$$') THEN 'noise' END, CASE WHEN contains(text, ' | ') THEN 'table' END], lambda x: x IS NOT NULL)) AS reason FROM documents)
SELECT reason, count(*) AS n FROM r GROUP BY reason""")
def reason_code_distribution(spark, sf_dir):
    from ..operators.filters import violations

    rules = {"short": F.col("n_chars") < 100, "noise": F.contains("text", F.lit("$$$")), "table": F.contains("text", F.lit(" | "))}
    d = table(spark, sf_dir, "documents").select(violations(rules).alias("reasons"))
    return aggregates.exploded_counts(d, "reasons", "reason")


@query("""
WITH s AS (SELECT event_id, event_type, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'not a time' ELSE strftime(ts, '%Y%m%d%H%M%S') END AS stamp, date_trunc('second', ts) AS t FROM events)
SELECT count(*) AS rows, count(*) FILTER (event_type <> 'error') AS valid, count(*) FILTER (event_id % 5 <> 0) AS stamp_present, count(*) FILTER (event_id % 5 > 1) AS stamp_parsed,
  count(*) FILTER (event_id % 5 = 0) AS stamp_missing, count(*) FILTER (event_id % 5 = 1) AS stamp_invalid, min(t) FILTER (event_id % 5 > 1) AS first_stamp, max(t) FILTER (event_id % 5 > 1) AS last_stamp,
  count(*) FILTER (event_id % 5 > 1 AND t < TIMESTAMP '2024-01-15') AS before_batch, count(*) FILTER (event_id % 5 > 1 AND t = TIMESTAMP '2024-01-15') AS at_batch,
  count(*) FILTER (event_id % 5 > 1 AND t > TIMESTAMP '2024-01-15') AS after_batch FROM s""")
def scan_profile(spark, sf_dir):
    k = F.col("event_id") % 5
    stamp = F.when(k == 0, "").when(k == 1, "not a time").otherwise(F.date_format("ts", "yyyyMMddHHmmss"))
    e = table(spark, sf_dir, "events").select("event_type", stamp.alias("stamp"))
    return aggregates.scan_profile(e, F.col("event_type") != "error", F.col("stamp"), F.lit("2024-01-15").cast("timestamp"))


@query("""
WITH c AS (SELECT o_orderpriority, count(*) FILTER (o_orderdate < TIMESTAMP '1998-01-01') AS before, count(*) FILTER (o_orderdate >= TIMESTAMP '1998-01-01') AS now FROM orders GROUP BY 1)
SELECT o_orderpriority, before, now, now < floor(before * 0.8) AS shrunk FROM c""")
def shrink_guard(spark, sf_dir):
    split = F.lit("1998-01-01").cast("timestamp")
    c = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.count_if(F.col("o_orderdate") < split).alias("before"), F.count_if(F.col("o_orderdate") >= split).alias("now")
    )
    return c.withColumn("shrunk", aggregates.shrink_guard(F.col("now"), F.col("before"), 0.2))


@query("""
SELECT event_type, count(*) AS n, round(100.0 * count(*) FILTER (value >= 10) / count(*), 2) AS high_percent, CAST(sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing
FROM events GROUP BY event_type""")
def conditional_coverage(spark, sf_dir):
    n = F.count(F.lit(1))
    high = F.round(F.count_if(F.col("value") >= 10) * 100.0 / n, 2)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(n.alias("n"), high.cast("double").alias("high_percent"), F.count_if(F.col("value").isNull()).alias("missing"))
