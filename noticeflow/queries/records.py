"""Queries over whole records, evaluation and provider health."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import records
from ..operators import nested
from ..operators.shared import Scratch
from ..plans import evaluate
from .registry import query, table


@query(r"""
SELECT page_id, regexp_replace(url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'serviceKey=abc&n=1', '(?i)([?&](?:serviceKey|apiKey|api_key|token|password|secret|client_secret|authorization)=)[^&#]*', '\1***', 'g') AS masked,
  regexp_matches(CASE WHEN page_id % 4 = 0 THEN 'http://localhost/x' WHEN page_id % 4 = 1 THEN 'C:\temp' ELSE url END, '(?i)(^|[^a-z])([a-z]:\\|file://|/home/|/users/|/root/|localhost|127\.0\.0\.1)') AS unsafe FROM pages""")
def mask_secrets(spark, sf_dir):
    k = F.col("page_id") % 4
    url = F.concat("url", F.when(F.contains("url", F.lit("?")), "&").otherwise("?"), F.lit("serviceKey=abc&n=1"))
    named = F.when(k == 0, "http://localhost/x").when(k == 1, "C:\\temp").otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", records.masked_url(url).alias("masked"), records.unsafe_reference(named).alias("unsafe"))


@query("""
SELECT event_id, '{"token":"***","k":' || (event_id % 7) || '}' AS payload FROM events""")
def redact_payload(spark, sf_dir):
    raw = F.concat(F.lit('{"token":"s'), F.col("event_id").cast("string"), F.lit('","k":'), (F.col("event_id") % 7).cast("string"), F.lit("}"))
    return table(spark, sf_dir, "events").select("event_id", records.redacted_json(raw).alias("payload"))


@query("""
SELECT event_id, CAST(event_id % 7 AS VARCHAR) AS k, event_type AS item_2, CAST(3 AS BIGINT) AS leaves FROM events""")
def flatten_json(spark, sf_dir):
    raw = F.concat(F.lit('{"a":{"k":'), (F.col("event_id") % 7).cast("string"), F.lit('},"item":["x","'), F.col("event_type"), F.lit('"]}'))
    e = table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
    m = nested.flattened(nested.nodes(e, ["event_id"], "raw", Scratch(spark, "flat")), ["event_id"])
    return m.select("event_id", F.col("leaves")["k"].alias("k"), F.col("leaves")["item_2"].alias("item_2"), F.size("leaves").cast("long").alias("leaves"))


@query(r"""
WITH l AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '[ \t\r\n\f\x0B]+', ' ', 'g'))) AS lines FROM documents)
SELECT doc_id, array_to_string(list_slice(list_filter(lines, lambda x: contains(lower(x), 'licen') OR contains(lower(x), 'token')), 1, 1), chr(10)) AS found,
  substr(array_to_string(list_slice(list_filter(lines, lambda x: length(x) >= 20), 1, 2), ' '), 1, 200) AS summary FROM l""")
def select_lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", records.lines_with("text", ["licen", "Token"], 1).alias("found"), records.summary_lines("text", 20, 2, 200).alias("summary"))


@query("""
SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderstatus = 'O' THEN 'open_detail' END, CASE WHEN o_totalprice > 200000 THEN 'call' END, CASE WHEN o_orderpriority = '1-URGENT' THEN 'open_detail_now' END], lambda x: x IS NOT NULL), ',') AS actions,
  CASE o_orderstatus WHEN 'O' THEN '{"no":' || o_orderkey || '}' WHEN 'F' THEN '{"customer":' || o_custkey || '}' ELSE '{}' END AS lookup FROM orders""")
def manual_check_actions(spark, sf_dir):
    status = F.col("o_orderstatus")
    names = records.actions([("open_detail", status == "O"), ("call", F.col("o_totalprice") > 200000), ("open_detail_now", F.col("o_orderpriority") == "1-URGENT")])
    key = records.lookup_key(status, {"O": [("no", F.col("o_orderkey"))], "F": [("customer", F.col("o_custkey"))]})
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(names, ",").alias("actions"), key.alias("lookup"))


@query("""
WITH s AS (SELECT user_id, count(*) AS rows, count(*) FILTER (event_type = 'error') AS errors, CASE WHEN user_id % 10 = 0 THEN 'incomplete' WHEN count(*) FILTER (event_type = 'purchase') > 0 AND count(*) > 3 THEN 'success' ELSE 'failed' END AS status FROM events GROUP BY user_id),
t AS (SELECT count(*) AS samples, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'incomplete') AS incomplete, CAST(sum(rows) AS BIGINT) AS rows, CAST(sum(errors) AS BIGINT) AS errors FROM s)
SELECT *, round(CAST(success AS DOUBLE) / nullif(samples, 0), 4) AS success_rate,
  CASE WHEN samples < 6 THEN 'insufficient_samples' WHEN rows < 20 THEN 'insufficient_labels' WHEN round(CAST(success AS DOUBLE) / nullif(samples, 0), 4) < 0.9 THEN 'below_threshold' ELSE 'accepted' END AS decision FROM t""")
def sample_evaluation(spark, sf_dir):
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("event_type") == "purchase").alias("bought")
    )
    s = s.withColumn("status", evaluate.sample_status(F.col("user_id") % 10 == 0, [F.col("bought") > 0, F.col("rows") > 3]))
    out = evaluate.totals(s, ["rows", "errors"])
    return out.withColumn("decision", evaluate.decision(F.col("samples"), F.col("rows"), F.col("success_rate"), F.lit(1.0)))


@query("""
WITH m AS (SELECT doc_id, list_filter([CASE WHEN contains(text, 'en') THEN 'x' END, CASE WHEN contains(text, 'the') THEN 'y' END], lambda v: v IS NOT NULL) AS packs, contains(text, '$$$') AS noisy FROM documents)
SELECT pack, count(*) AS observations, count(*) FILTER (noisy) AS noisy, round(CAST(count(*) FILTER (noisy) AS DOUBLE) / count(*), 4) AS noise_ratio
FROM (SELECT unnest(packs) AS pack, noisy FROM m) GROUP BY pack""")
def pack_quality(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    tag = lambda *xs: F.array_compact(F.array(*[F.when(F.contains("text", F.lit(t)), F.lit(n)) for n, t in xs]))
    return evaluate.pack_quality(d.select(tag(("x", "en"), ("y", "the")).alias("packs"), tag(("n", "$$$")).alias("noise")), "packs", "noise")


@query("""
WITH p(pack, query) AS (VALUES ('core', '"modular housing" OR "prefab"'), ('more', '"off-site"')),
m AS (SELECT n_name AS country, pack, query, sha256(n_name || '|' || pack || '|' || query) AS fingerprint FROM nation, p)
SELECT country, pack, fingerprint FROM m WHERE NOT (pack = 'core' AND country LIKE '%1')""")
def stale_checkpoints(spark, sf_dir):
    countries = table(spark, sf_dir, "nation").select(F.col("n_name").alias("country"))
    manifest = evaluate.query_manifest(countries, {"core": ["Modular housing", "modular HOUSING", "prefab"], "more": ["off-site"]})
    changed = ~((F.col("pack") == "core") & F.endswith("country", F.lit("1")))
    checkpoint = manifest.select("country", "pack", F.when(changed, F.concat("fingerprint", F.lit("x"))).otherwise(F.col("fingerprint")).alias("fingerprint"))
    out = evaluate.stale_checkpoints(checkpoint, manifest, ["country", "pack"])
    return out.withColumn("fingerprint", F.regexp_replace("fingerprint", "x$", ""))


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events),
u AS (SELECT user_id, event_type, date_trunc('second', ts) + to_seconds(CASE event_type WHEN 'error' THEN 3600 WHEN 'purchase' THEN 10 ELSE 900 END) AS until FROM r WHERE k = 1)
SELECT user_id, until, TIMESTAMP '2024-01-30 23:30:00' < until AS cooling, CASE WHEN user_id % 9 = 0 THEN 'bad_query' WHEN event_type = 'error' AND user_id % 2 = 0 THEN 'quarantined' WHEN TIMESTAMP '2024-01-30 23:30:00' < until THEN 'cooling_down' END AS skip FROM u""")
def provider_cooldown(spark, sf_dir):
    status = F.when(F.col("event_type") == "error", 429).when(F.col("event_type") == "purchase", 200).otherwise(500)
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("at"), "event_id", status.alias("status"))
    out = evaluate.cooldowns(e, "user_id", ["at", "event_id"], F.lit(datetime(2024, 1, 30, 23, 30)).cast("timestamp"), {429: 3600, 200: 10}, 900)
    out = evaluate.choose(out, F.col("user_id") % 9 == 0, (F.col("status") == 429) & (F.col("user_id") % 2 == 0), F.col("cooling"))
    return out.select("user_id", F.col("until").cast("timestamp_ntz").alias("until"), "cooling", "skip")


@query("""
SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS amount, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, CAST(max(o_orderdate) AS DATE) AS newest FROM orders GROUP BY o_orderstatus""")
def amount_summary(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("amount"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.to_date(F.max("o_orderdate")).alias("newest")
    )
