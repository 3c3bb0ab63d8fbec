"""Streaming queries over the events as a file stream, run to the end of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.shared import shared_folder
from ..sources.recorded_stream import NoticeStream
from ..streaming import cooldown, streams
from .registry import query, table


def _run(spark, sf_dir, build, mode, files=1):
    events = table(spark, sf_dir, "events")
    stream = streams.file_stream(spark, f"{sf_dir}/events.parquet*", events.schema, "ts", files)
    return streams.run_to_files(build(stream), f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}", mode)


@query("SELECT DISTINCT event_type, user_id FROM events")
def stream_watermark_dedup(spark, sf_dir):
    return _run(spark, sf_dir, lambda s: streams.dedup_in_watermark(s, "ts", ["event_type", "user_id"], "400 days").select("event_type", "user_id"), "append")


@query("""
SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def stream_tumbling(spark, sf_dir):
    out = _run(spark, sf_dir, lambda s: streams.tumbling_counts(s, "ts", "event_type", "value", "1 day", "1 hour"), "complete")
    return out.selectExpr("cast(start as timestamp_ntz) as start", "event_type", "n", "round(total, 4) as total")


@query("""
WITH RECURSIVE a AS (SELECT user_id, date_trunc('milliseconds', ts) AS t, CASE event_type WHEN 'error' THEN 429 WHEN 'purchase' THEN 200 ELSE 500 END AS status FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, status) AS k FROM a),
r(user_id, k, strikes, until) AS (SELECT DISTINCT user_id, 0::BIGINT, 0, NULL::TIMESTAMP FROM n UNION ALL
  SELECT user_id, k, strikes, t + to_seconds(CASE WHEN strikes >= 3 THEN 86400 WHEN status = 429 THEN 3600 WHEN status = 200 THEN 10 ELSE 900 END)
  FROM (SELECT n.user_id, n.k, n.t, n.status, CASE n.status WHEN 200 THEN 0 ELSE CASE WHEN r.until <= n.t THEN 0 ELSE r.strikes END + CASE n.status WHEN 429 THEN 1 ELSE 0 END END AS strikes FROM r JOIN n ON n.user_id = r.user_id AND n.k = r.k + 1)),
u AS (SELECT *, (SELECT max(t) - INTERVAL 1 HOUR FROM a) AS mark FROM r WHERE k > 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1)
SELECT user_id, until, CASE WHEN until <= mark THEN 0 ELSE strikes END AS strikes, CASE WHEN until <= mark THEN 'free' WHEN strikes >= 3 THEN 'quarantined' ELSE 'cooling' END AS state FROM u""")
def stream_cooldown_timers(spark, sf_dir):
    status = F.when(F.col("event_type") == "error", 429).when(F.col("event_type") == "purchase", 200).otherwise(500)
    before = cooldown.rocks(spark)
    try:
        states = lambda s: cooldown.cooldown_states(s.select("user_id", "ts", status.alias("status")), "user_id", "ts", "status", "1 hour")
        # a table's files are in no order of time: taken one by one, the watermark of the first would make the next ones late
        changes = _run(spark, sf_dir, states, "update", files=2**31 - 1)
    finally:
        cooldown.restore(spark, before)
    return cooldown.last_states(changes, "user_id").select("user_id", F.col("until").cast("timestamp_ntz").alias("until"), "strikes", "state")


@query("""
WITH f AS (SELECT 'c' || (event_id % 5) AS country, event_type AS pack, CASE WHEN event_id % 3 = 0 THEN 7 ELSE 30 END AS days, event_id, user_id FROM events WHERE NOT (event_id % 5 = 2 AND event_id % 3 = 0)),
w AS (SELECT country, pack, min(days) AS days FROM f GROUP BY ALL)
SELECT country, pack, days, count(*) AS records, count(DISTINCT event_id) AS ids, sum(user_id)::BIGINT AS users FROM f JOIN w USING (country, pack, days) GROUP BY ALL""")
def stream_recorded_pages(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumns({"c": F.col("event_id") % 5, "w": F.col("event_id") % 3})
    record = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("user_id").alias("user")))
    pages = e.where("not (c = 2 and w = 0)").select(
        F.concat(F.lit("c"), "c").alias("country"), F.col("event_type").alias("pack"), F.when(F.col("w") == 0, 7).otherwise(30).alias("days"), record.alias("value"), (F.hash("event_id") % 4).alias("page")
    )
    folder = f"{shared_folder(spark)}/feeds-{uuid.uuid4().hex}"
    pages.repartition(4, "page").drop("page").write.partitionBy("country", "pack", "days").text(f"{folder}/pages")
    spark.dataSource.register(NoticeStream)
    stream = spark.readStream.format("notice_stream").options(folder=f"{folder}/pages").load()
    read = streams.run_to_files(stream, f"{folder}/out", "append")
    id, user = (F.get_json_object("record", p).cast("long") for p in ("$.id", "$.user"))
    return read.groupBy("country", "pack", "days").agg(F.count(F.lit(1)).alias("records"), F.count_distinct(id).alias("ids"), F.sum(user).alias("users"))
