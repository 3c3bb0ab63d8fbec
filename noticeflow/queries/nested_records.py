"""Queries of nested payloads and versioned artifacts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import nested
from ..operators.shared import Scratch, shared_folder
from ..sources import artifacts
from ..sources.packed_lines import PackedLines, file_figures
from .registry import query, table

#: Payloads three levels deep and more, with lists of lists, from events; every 11th is no JSON, every 13th is null.
PAYLOAD_SQL = """p AS (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 11 = 0 THEN '{"no":"N' || user_id || '"' ELSE
  '{"response":{"header":{"resultCode":"00","note":null},"body":{"items":[{"no":"N' || user_id || '","kind":"' || event_type || '"},[{"no":"N' || (event_id % 400) || '","deep":{"no":"N' || (event_id % 90)
  || '","text":"modular ' || event_type || '"}}],' || (event_id % 7) || '],"props":' || props || '}}}' END AS payload FROM events)"""


def _payloads(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    number = lambda c: F.concat(F.lit('{"no":"N'), c.cast("string"), F.lit('"'))
    whole = F.concat(
        F.lit('{"response":{"header":{"resultCode":"00","note":null},"body":{"items":['), number(F.col("user_id")), F.lit(',"kind":"'), F.col("event_type"), F.lit('"},['),
        number(k % 400), F.lit(',"deep":'), number(k % 90), F.lit(',"text":"modular '), F.col("event_type"), F.lit('"}}],'), (k % 7).cast("string"),
        F.lit('],"props":'), F.col("props"), F.lit("}}}"),
    )
    broken = F.when(k % 13 == 0, None).when(k % 11 == 0, number(F.col("user_id")))
    return e.select("event_id", F.when((k % 13 == 0) | (k % 11 == 0), broken).otherwise(whole).alias("payload"))


@query("WITH " + PAYLOAD_SQL + """, j AS (SELECT event_id, CASE WHEN json_valid(payload) THEN payload::JSON END AS j FROM p),
t AS (SELECT j.event_id, x.value AS v, x.fullkey AS place, json_extract_string(x.value, '$.no') AS number FROM j, json_tree(j.j) x WHERE x.type = 'OBJECT'),
k(number, word) AS (VALUES ('N3', 'modular error'), ('N57', ''), ('N399', 'no such')),
o AS (SELECT event_id, number, count(*) AS objects FROM t JOIN k USING (number) GROUP BY ALL),
n AS (SELECT event_id, number FROM p JOIN k ON contains(payload, number) OR (word <> '' AND contains(payload, word)) UNION SELECT event_id, number FROM o)
SELECT event_id, number, CASE WHEN objects IS NULL THEN 'text' ELSE 'object' END AS how, coalesce(objects, 0) AS objects FROM n LEFT JOIN o USING (event_id, number)""")
def known_record_search(spark, sf_dir):
    known = spark.createDataFrame([("N3", ["modular error"]), ("N57", []), ("N399", ["", "no such"])], "number string, words array<string>")
    found = nested.known_records(_payloads(spark, sf_dir), ["event_id"], "payload", "no", known, "number", "words", Scratch(spark, "nested"))
    return found.drop("at", "object")


@query("WITH " + PAYLOAD_SQL + """, j AS (SELECT event_id, CASE WHEN json_valid(payload) THEN payload::JSON END AS j FROM p),
t AS (SELECT j.event_id, x.type AS kind, length(x.fullkey) - length(replace(replace(x.fullkey, '.', ''), '[', '')) AS depth FROM j, json_tree(j.j) x)
SELECT CASE kind WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'NULL' THEN 'null' ELSE 'value' END AS kind, depth::INTEGER AS depth, count(*) AS nodes FROM t GROUP BY ALL""")
def nested_nodes(spark, sf_dir):
    found = nested.nodes(_payloads(spark, sf_dir), ["event_id"], "payload", Scratch(spark, "nested"))
    return found.groupBy("kind", "depth").agg(F.count(F.lit(1)).alias("nodes"))


#: Lines of the artifacts: a JSON object per row, whose bytes SQL can count.
@query("""
WITH l AS (SELECT 'orders-' || lower(o_orderstatus) || '.jsonl' AS artifact, '{"key":' || o_orderkey || ',"priority":"' || o_orderpriority || '"}' AS line FROM orders
UNION ALL SELECT 'events-' || event_type || '.jsonl', '{"id":' || event_id || ',"user":' || user_id || '}' FROM events
UNION ALL SELECT 'nations.jsonl', '{"name":"' || n_name || '"}' FROM nation)
SELECT artifact, count(*) AS rows, sum(strlen(line) + 1)::BIGINT AS bytes, true AS intact, sum(hash_line)::BIGINT AS read_back
FROM (SELECT *, strlen(line) AS hash_line FROM l) GROUP BY artifact""")
def artifact_export(spark, sf_dir):
    line = lambda df, name, position, *fields: df.select(name.alias("artifact"), position.alias("position"), F.to_json(F.struct(*fields)).alias("record"))
    o, e, n = (table(spark, sf_dir, t) for t in ("orders", "events", "nation"))
    rows = line(o, F.concat(F.lit("orders-"), F.lower("o_orderstatus"), F.lit(".jsonl")), F.col("o_orderkey"), F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("priority"))
    rows = rows.unionByName(line(e, F.concat(F.lit("events-"), F.col("event_type"), F.lit(".jsonl")), F.col("event_id"), F.col("event_id").alias("id"), F.col("user_id").alias("user")))
    rows = rows.unionByName(line(n, F.lit("nations.jsonl"), F.col("n_nationkey").cast("long"), F.col("n_name").alias("name")))
    path = f"{shared_folder(spark)}/artifacts-{uuid.uuid4().hex}"
    artifacts.export(rows, path, "1")
    back = artifacts.records(spark, path, "1").groupBy("artifact").agg(F.sum(F.octet_length("record")).cast("long").alias("read_back"))
    return artifacts.audited(spark, path, "1").drop("parts").join(back, "artifact")


@query("""
WITH l AS (SELECT doc_id || ':' || regexp_replace(coalesce(text, ''), '[\\n\\r]', ' ', 'g') AS line FROM documents)
SELECT count(*) AS lines, count(*) FILTER (octet_length(encode(line)) > 5000) AS rejected, count(*) FILTER (octet_length(encode(line)) <= 5000) AS kept,
  sum(octet_length(encode(line)) + 1)::BIGINT AS raw_bytes, sum(octet_length(encode(line))) FILTER (octet_length(encode(line)) <= 5000)::BIGINT AS kept_bytes, true AS held, true AS whole FROM l""")
def packed_scan(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    line = F.concat_ws(":", F.col("doc_id").cast("string"), F.regexp_replace(F.coalesce("text", F.lit("")), "[\n\r]", " "))
    folder = f"{shared_folder(spark)}/packed-{uuid.uuid4().hex}"
    d.select(line.alias("value")).repartition(8).write.option("compression", "gzip").text(folder)
    spark.dataSource.register(PackedLines)
    rows = Scratch(spark, "packed").keep(spark.read.format("packed_lines").options(path=folder, max_line="5000").load(), "rows")
    files = file_figures(rows).agg(
        F.sum("lines").alias("lines"), F.sum("rejected").alias("rejected"), F.sum("raw_bytes").alias("raw_bytes"), F.bool_and("held").alias("held"),
        F.bool_and(F.col("reason").isNull() & (F.length("sha256") == 64)).alias("whole"),
    )
    kept = rows.where("kind = 'line'").agg(F.count(F.lit(1)).alias("kept"), F.sum(F.octet_length("line")).cast("long").alias("kept_bytes"))
    return files.join(kept)
