"""Joins, merges, diffs and upserts on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import components, joins, windows
from .registry import query, table


@query("""
WITH r AS (SELECT l_orderkey, l_shipdate, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC) AS k FROM lineitem)
SELECT o_orderkey, coalesce(l_shipdate, o_orderdate) AS shipped, l_orderkey IS NOT NULL AS joined
FROM orders LEFT JOIN r ON o_orderkey = l_orderkey AND k = 1""")
def enrich_last_wins_left(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("shipped"))
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_shipdate").alias("shipped"), "l_linenumber")
    return joins.enrich_last_wins(o, li, "o_orderkey", ["shipped", "l_linenumber"], ["shipped"])


@query("""
SELECT event_id, ts, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1""")
def latest_per_key(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    return joins.latest(e, ["user_id"], ["ts", "event_id"])


@query("""
WITH d AS (SELECT * FROM events WHERE event_type IN ('purchase', 'signup') AND value >= 150), q AS (SELECT * FROM events),
a AS (SELECT user_id, event_type, arg_max(value, event_id) AS v, max(event_id) AS e FROM d GROUP BY 1, 2),
b AS (SELECT user_id, arg_max(value, event_id) AS v, max(event_id) AS e FROM d GROUP BY 1)
SELECT q.event_id, coalesce(a.v, b.v) AS found_value, CASE WHEN a.e IS NOT NULL THEN a.e ELSE b.e END AS found_event,
       CASE WHEN a.e IS NOT NULL THEN 0 WHEN b.e IS NOT NULL THEN 1 END AS tier
FROM q LEFT JOIN a ON q.user_id = a.user_id AND q.event_type = a.event_type LEFT JOIN b ON q.user_id = b.user_id""")
def cascade_lookup(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    details = e.where("event_type IN ('purchase', 'signup') AND value >= 150").select("user_id", "event_type", F.col("value").alias("found_value"), F.col("event_id").alias("found_event"))
    asked = e.select("event_id", "user_id", "event_type")
    tiers = [["user_id", "event_type"], ["user_id"]]
    return joins.cascade_lookup(asked, details, tiers, ["found_event"], ["found_value", "found_event"]).drop("user_id", "event_type")


@query("SELECT * FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def semi_favorites(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_totalprice > 200000")
    c = table(spark, sf_dir, "customer")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi")


@query("SELECT * FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def anti_missing(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where("o_totalprice > 450000")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti")


#: The old snapshot holds the orders placed before 2000, the fresh one those that are still open.
MERGE_SQL = """
WITH e AS (SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01'),
f AS (SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN ' ' ELSE 'N' END AS o_orderstatus,
  CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE 0.0 END AS o_totalprice, 'NEW' AS o_orderpriority FROM orders WHERE o_orderstatus IN ('O', 'P'))"""


def merge_sides(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    fresh = o.where("o_orderstatus IN ('O', 'P')").select(
        "o_orderkey", F.when(key % 6 == 0, " ").otherwise("N").alias("o_orderstatus"),
        F.when(key % 10 != 0, F.lit(0.0)).alias("o_totalprice"), F.lit("NEW").alias("o_orderpriority"),
    )
    existing = o.where("o_orderdate < TIMESTAMP '2000-01-01'")
    return existing.select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"), fresh


@query(MERGE_SQL + """
SELECT coalesce(e.o_orderkey, f.o_orderkey) AS o_orderkey,
  CASE WHEN trim(coalesce(f.o_orderstatus, '')) <> '' THEN f.o_orderstatus ELSE e.o_orderstatus END AS o_orderstatus,
  coalesce(f.o_totalprice, e.o_totalprice) AS o_totalprice,
  CASE WHEN trim(coalesce(e.o_orderpriority, '')) <> '' THEN e.o_orderpriority ELSE f.o_orderpriority END AS o_orderpriority,
  CASE WHEN f.o_orderkey IS NULL THEN 'existing' WHEN e.o_orderkey IS NULL THEN 'fresh' ELSE 'both' END AS origin
FROM e FULL JOIN f ON e.o_orderkey = f.o_orderkey""")
def coalescing_merge(spark, sf_dir):
    existing, fresh = merge_sides(spark, sf_dir)
    return joins.coalescing_merge(existing, fresh, "o_orderkey", keep=["o_orderpriority"])


@query(MERGE_SQL + """
SELECT coalesce(e.o_orderkey, f.o_orderkey) AS o_orderkey,
  CASE WHEN e.o_orderkey IS NULL THEN 'added' WHEN f.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS change,
  CASE WHEN e.o_orderkey IS NULL OR f.o_orderkey IS NULL THEN '' ELSE concat_ws(',',
    CASE WHEN e.o_orderpriority IS DISTINCT FROM f.o_orderpriority THEN 'o_orderpriority' END,
    CASE WHEN e.o_orderstatus IS DISTINCT FROM f.o_orderstatus THEN 'o_orderstatus' END,
    CASE WHEN e.o_totalprice IS DISTINCT FROM f.o_totalprice THEN 'o_totalprice' END) END AS changed_columns
FROM e FULL JOIN f ON e.o_orderkey = f.o_orderkey""")
def snapshot_diff(spark, sf_dir):
    before, after = merge_sides(spark, sf_dir)
    return joins.snapshot_diff(before, after, "o_orderkey").withColumn("changed_columns", F.array_join("changed_columns", ","))


@query(MERGE_SQL + """, a AS (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT e.* FROM e WHERE o_orderkey NOT IN (SELECT o_orderkey FROM f) AND o_orderkey NOT IN (SELECT o_orderkey FROM a)""")
def unapproved_removals(spark, sf_dir):
    before, after = merge_sides(spark, sf_dir)
    reason = F.when(F.col("o_orderpriority") == "1-URGENT", "agreed").otherwise(" ")
    allowed = before.select("o_orderkey", reason.alias("reason"))
    return joins.unapproved_removals(before, after, allowed, "o_orderkey")


@query("""
SELECT s_suppkey, greatest((SELECT max(c_custkey) FROM customer WHERE c_nationkey = s_nationkey), (SELECT max(c_custkey) FROM customer WHERE c_custkey = s_suppkey)) AS customer
FROM supplier""")
def or_key_lookup(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    out = joins.either_key(s, table(spark, sf_dir, "customer"), [("s_nationkey", "c_nationkey"), ("s_suppkey", "c_custkey")], "c_custkey", "customer")
    return out.drop("s_nationkey")


@query(MERGE_SQL + """
SELECT coalesce(f.o_orderkey, e.o_orderkey) AS o_orderkey,
  CASE WHEN f.o_orderkey IS NOT NULL THEN f.o_orderstatus ELSE e.o_orderstatus END AS o_orderstatus,
  CASE WHEN f.o_orderkey IS NOT NULL THEN f.o_totalprice ELSE e.o_totalprice END AS o_totalprice,
  CASE WHEN f.o_orderkey IS NULL THEN 'kept' WHEN e.o_orderkey IS NULL THEN 'inserted'
       WHEN e.o_orderstatus IS NOT DISTINCT FROM f.o_orderstatus AND e.o_totalprice IS NOT DISTINCT FROM f.o_totalprice THEN 'skipped' ELSE 'updated' END AS status
FROM (SELECT o_orderkey, o_orderstatus, o_totalprice FROM e) e
FULL JOIN (SELECT o_orderkey, CASE WHEN x.o_orderpriority = '5-LOW' THEN x.o_orderstatus ELSE f.o_orderstatus END AS o_orderstatus,
  CASE WHEN x.o_orderpriority = '5-LOW' THEN x.o_totalprice ELSE f.o_totalprice END AS o_totalprice FROM f JOIN orders x USING (o_orderkey)) f ON e.o_orderkey = f.o_orderkey""")
def upsert_status(spark, sf_dir):
    columns = ["o_orderkey", "o_orderstatus", "o_totalprice"]
    existing, fresh = (d.select(*columns) for d in merge_sides(spark, sf_dir))
    same = table(spark, sf_dir, "orders").where("o_orderstatus IN ('O', 'P') AND o_orderpriority = '5-LOW'").select(*columns)
    batch = fresh.join(same, "o_orderkey", "left_anti").unionByName(same)
    return joins.upsert(existing, batch, ["o_orderkey"], ["o_orderstatus", "o_totalprice"])


@query("""
WITH s AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS t FROM events WHERE event_id % 3 = 0 GROUP BY user_id),
b AS (SELECT event_id, user_id, event_type AS t, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events WHERE event_id % 3 <> 0)
SELECT event_id, b.user_id, b.t AS event_type, CASE WHEN coalesce(before, s.t) IS NULL THEN 'inserted' WHEN coalesce(before, s.t) = b.t THEN 'skipped' ELSE 'updated' END AS status
FROM b LEFT JOIN s ON b.user_id = s.user_id""")
def upsert_in_order(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    stored = joins.latest(e.where("event_id % 3 = 0"), ["user_id"], ["ts", "event_id"])
    batch = e.where("event_id % 3 <> 0")
    return joins.applied_in_order(stored, batch, ["user_id"], ["event_type"], ["ts", "event_id"]).drop("ts")


@query("""
WITH s AS (SELECT user_id, event_type, value, event_id FROM events WHERE event_id % 2 = 0), b AS (SELECT * FROM events WHERE event_id % 2 = 1),
n AS (SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, max((ts, event_id)).event_id AS event_id FROM (SELECT user_id, event_type, value, ts, event_id FROM b) GROUP BY 1, 2),
o AS (SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM s GROUP BY 1, 2)
SELECT coalesce(n.user_id, o.user_id) AS user_id, coalesce(n.event_type, o.event_type) AS event_type, CASE WHEN n.user_id IS NULL THEN o.value ELSE n.value END AS value,
  CASE WHEN n.user_id IS NULL THEN 'kept' WHEN o.user_id IS NULL THEN 'inserted' WHEN n.value IS NOT DISTINCT FROM o.value THEN 'skipped' ELSE 'updated' END AS status
FROM n FULL JOIN o ON n.user_id = o.user_id AND n.event_type = o.event_type""".replace("max((ts, event_id)).event_id", "arg_max(event_id, (ts, event_id))"))
def upsert_last_arrival(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    stored = joins.latest(e.where("event_id % 2 = 0").select("user_id", "event_type", "value", "event_id"), ["user_id", "event_type"], ["event_id"])
    return joins.upsert(stored.drop("event_id"), e.where("event_id % 2 = 1"), ["user_id", "event_type"], ["value"], ["ts", "event_id"])


@query("""
WITH s AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'h' || (o_orderkey // 2) END AS hash, CASE WHEN o_orderkey % 5 = 0 THEN 'http://x/' || (o_orderkey // 7) END AS url,
  o_orderpriority AS title, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderkey % 2 = 1),
b AS (SELECT o_orderkey AS no, CASE WHEN o_orderkey % 4 = 0 THEN 'h' || (o_orderkey // 2 + 1) END AS hash, CASE WHEN o_orderkey % 3 <> 0 THEN 'http://x/' || (o_orderkey // 7) END AS url,
  o_orderpriority AS title, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderkey % 2 = 0),
h AS (SELECT hash, max(id) AS id FROM s GROUP BY hash), u AS (SELECT url, max(id) AS id FROM s GROUP BY url), t AS (SELECT title, day, max(id) AS id FROM s GROUP BY title, day)
SELECT no, coalesce(h.id, u.id, t.id) AS stored_key, CASE WHEN h.id IS NOT NULL THEN 0 WHEN u.id IS NOT NULL THEN 1 WHEN t.id IS NOT NULL THEN 2 END AS tier
FROM b LEFT JOIN h ON b.hash = h.hash LEFT JOIN u ON b.url = u.url LEFT JOIN t ON b.title = t.title AND b.day = t.day""")
def upsert_key_cascade(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select("*", F.col("o_orderpriority").alias("title"), F.to_date("o_orderdate").alias("day"))
    name = lambda when, prefix, number: F.when(when, F.concat(F.lit(prefix), number.cast("string")))
    half, seventh = F.floor(k / 2), F.floor(k / 7)
    stored = o.where("o_orderkey % 2 = 1").select(k.alias("id"), name(k % 3 == 0, "h", half).alias("hash"), name(k % 5 == 0, "http://x/", seventh).alias("url"), "title", "day")
    batch = o.where("o_orderkey % 2 = 0").select(k.alias("no"), name(k % 4 == 0, "h", half + 1).alias("hash"), name(k % 3 != 0, "http://x/", seventh).alias("url"), "title", "day")
    return joins.resolved_keys(batch, stored, [["hash"], ["url"], ["title", "day"]], "id").select("no", "stored_key", "tier")


@query("""
SELECT event_id, user_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1""")
def first_wins_dedup(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    return joins.first_wins(e, ["user_id", "event_type"], ["ts", "event_id"])


@query("""
WITH g AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 3 = 0 THEN CAST(user_id AS VARCHAR) ELSE 'e' || event_id END AS given FROM events),
m AS (SELECT *, given IS NOT NULL AND row_number() OVER (PARTITION BY given ORDER BY event_id) = 1 AS good FROM g),
t AS (SELECT coalesce(max(TRY_CAST(given AS BIGINT)), 0) AS top FROM m)
SELECT event_id, CASE WHEN good THEN given ELSE CAST(top + row_number() OVER (PARTITION BY good ORDER BY event_id) AS VARCHAR) END AS id FROM m, t""")
def id_repair(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    given = F.when(F.col("event_id") % 5 == 0, None).when(F.col("event_id") % 3 == 0, F.col("user_id").cast("string")).otherwise(F.concat(F.lit("e"), F.col("event_id").cast("string")))
    return windows.repair_ids(e.select("event_id", given.alias("id")), "id", ["event_id"])


@query("""
SELECT event_id, user_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)
WHERE k <= 10 ORDER BY ts, event_id LIMIT 100""")
def quota_sample(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return windows.quota_sample(e, "user_id", ["ts", "event_id"], 100, 10)


@query("""
WITH m AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events)
SELECT user_id, min(ts) AS first, count(*) AS length FROM m WHERE event_type = 'error' GROUP BY user_id, island""")
def consecutive_error_runs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return windows.error_runs(e, "user_id", ["ts", "event_id"], F.col("event_type") == "error")


@query("""
WITH s AS (SELECT event_id, user_id, ts, CASE event_type WHEN 'error' THEN 429 WHEN 'purchase' THEN 200 ELSE 500 END AS status FROM events),
m AS (SELECT *, sum(CASE WHEN status = 200 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS era FROM s),
k AS (SELECT *, sum(CASE WHEN status = 429 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, era ORDER BY ts, event_id) AS strikes FROM m)
SELECT event_id, user_id, CAST(strikes AS BIGINT) AS strikes, strikes >= 2 AS quarantined FROM k""")
def provider_state(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", 429).when(F.col("event_type") == "purchase", 200).otherwise(500)
    out = windows.provider_states(e.select("event_id", "user_id", "ts", status.alias("status")), "user_id", ["ts", "event_id"], "status")
    return out.select("event_id", "user_id", "strikes", "quarantined")


def document_edges(spark, sf_dir):
    """Whole fields as keys: the text, its words, and its first line with language and source."""
    d = table(spark, sf_dir, "documents")
    # columns of their own: within the keys they would be computed for the condition and again for the value
    d = d.withColumns({"words": text.unicode_words("text"), "head": text.unicode_words(F.substring_index("text", "\n", 1))})
    keys = {
        "same_text": F.sha2("text", 256), "same_words": F.when(F.col("words") != "", F.sha2("words", 256)),
        "same_title": F.when(F.col("head") != "", F.sha2(F.concat_ws("|", "lang", "source", "head"), 256)),
    }
    return components.key_edges(d, "doc_id", keys)


EDGES_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, text, lang, source, trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')) AS words,
  trim(regexp_replace(lower(coalesce(split_part(text, chr(10), 1), '')), '[^\p{L}\p{N}]+', ' ', 'g')) AS head FROM documents
), k AS (
  SELECT doc_id, 0 AS reason, sha256(text) AS key FROM w WHERE text IS NOT NULL UNION ALL SELECT doc_id, 1, sha256(words) FROM w WHERE words <> ''
  UNION ALL SELECT doc_id, 2, sha256(concat_ws('|', lang, source, head)) FROM w WHERE head <> ''
), e AS (SELECT doc_id AS a, b, reason FROM (SELECT doc_id, reason, min(doc_id) OVER (PARTITION BY reason, key) AS b FROM k) WHERE doc_id <> b
), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e
), r(node, root) AS (SELECT a, a FROM u UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.node
), c AS (SELECT node, min(root) AS root FROM r GROUP BY node)"""


@query(EDGES_SQL + " SELECT node, root FROM c WHERE root <> node")
def duplicate_components(spark, sf_dir):
    return components.components(document_edges(spark, sf_dir))


@query(EDGES_SQL + """, y AS (SELECT root, min(reason) AS reason FROM e JOIN c ON node = a GROUP BY root)
SELECT 'dup-' || substr(sha256(string_agg(CAST(node AS VARCHAR), '|' ORDER BY node)), 1, 12) AS group_id, c.root, CAST(count(*) AS INTEGER) AS members,
  ['same_text', 'same_words', 'same_title'][any_value(y.reason) + 1] AS reason FROM c JOIN y ON y.root = c.root GROUP BY c.root""")
def duplicate_groups(spark, sf_dir):
    return components.duplicate_groups(document_edges(spark, sf_dir), ["same_text", "same_words", "same_title"])


@query()
def near_duplicate_titles(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 5).cast("int"))
    rows = d.select("doc_id", F.substring_index("text", "\n", 1).alias("title"), F.concat_ws("-", "lang", "source").alias("domain"), day.alias("day"))
    return components.close_title_edges(rows, "doc_id", "title", "domain", "day")


@query("""
SELECT v, count(*) AS rows FROM (SELECT year(o_orderdate) AS v FROM orders) GROUP BY v ORDER BY rows DESC, v DESC LIMIT 1""")
def largest_snapshot(spark, sf_dir):
    from ..sources.readers import largest_version

    v = F.year("o_orderdate").cast("long").alias("v")
    return largest_version(table(spark, sf_dir, "orders").select(v))
