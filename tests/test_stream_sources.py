"""Streams with timers and a stream source that resumes."""

import json

from noticeflow.sources.recorded_stream import FeedReader, NoticeStream
from noticeflow.streaming import cooldown


def feed(folder, country, pack, days, pages):
    at = folder / f"country={country}/pack={pack}/days={days}"
    at.mkdir(parents=True, exist_ok=True)
    for n, records in pages.items():
        (at / f"{n:03d}.json").write_text("\n".join(json.dumps(r) for r in records) + "\n")


def run(spark, folder, out, check):
    stream = spark.readStream.format("notice_stream").options(folder=str(folder)).load()
    query = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(check)).trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted((r.country, r.pack, r.days, r.page, json.loads(r.record)["n"]) for r in spark.read.parquet(str(out)).collect())


def test_pages_once_each_across_restarts(spark, tmp_path):
    spark.dataSource.register(NoticeStream)
    folder = tmp_path / "feeds"
    feed(folder, "de", "core", 7, {i: [{"n": i}, {"n": 10 * i}] for i in range(1, 6)})
    feed(folder, "de", "core", 30, {1: [{"n": 999}]})
    feed(folder, "fr", "core", 30, {1: [{"n": 7}]})
    feed(folder, "fr", "more", 7, {})
    want = sorted([("de", "core", 7, i, n) for i in range(1, 6) for n in (i, 10 * i)] + [("fr", "core", 30, 1, 7)])
    assert run(spark, folder, tmp_path / "out", tmp_path / "check") == want
    # the process ends; later pages, and pages of a short window that was empty, arrive
    feed(folder, "de", "core", 7, {6: [{"n": 6}]})
    feed(folder, "fr", "more", 7, {1: [{"n": 8}]})
    feed(folder, "fr", "core", 7, {1: [{"n": 1000}]})
    want = sorted([*want, ("de", "core", 7, 6, 6), ("fr", "more", 7, 1, 8), ("fr", "core", 7, 1, 1000)])
    assert run(spark, folder, tmp_path / "out", tmp_path / "check") == want
    assert run(spark, folder, tmp_path / "out", tmp_path / "check") == want


def test_an_offset_says_what_a_batch_reads(tmp_path):
    feed(tmp_path, "de", "core", 30, {i: [{"n": i}] for i in range(1, 4)})
    first = FeedReader({"folder": str(tmp_path)}).latestOffset()
    assert first == {"country=de/pack=core": {"7": 0, "30": 3}}
    feed(tmp_path, "de", "core", 7, {1: [{"n": 9}]})
    feed(tmp_path, "de", "core", 30, {4: [{"n": 4}]})
    again = FeedReader({"folder": str(tmp_path)})
    assert [(p.days, p.number) for p in again.partitions({}, first)] == [(30, 1), (30, 2), (30, 3)]
    assert [(p.days, p.number) for p in again.partitions(first, again.latestOffset())] == [(7, 1)]


def test_timers_end_a_wait_without_another_attempt(spark, tmp_path):
    schema = "p string, at timestamp, s int"
    before = cooldown.rocks(spark)
    try:
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/in/0")
        batches = [
            [("a", "2024-01-01 00:00:00", 429), ("b", "2024-01-01 00:00:00", 200), ("c", "2024-01-01 00:00:00", 429), ("c", "2024-01-01 00:00:01", 429), ("c", "2024-01-01 00:00:02", 429)],
            [("a", "2024-01-01 00:30:00", 500), ("z", "2024-01-01 00:40:00", 200)],
            [("z", "2024-01-01 03:00:00", 200)],
        ]
        for n, rows in enumerate(batches, 1):
            df = spark.createDataFrame(rows, "p string, at string, s int").selectExpr("p", "cast(at as timestamp) as at", "s")
            df.coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
            stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
            states = cooldown.cooldown_states(stream, "p", "at", "s", "1 minute")
            out = states.writeStream.foreachBatch(lambda b, i, n=n: b.coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/out/{n}-{i}"))
            out.outputMode("update").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    finally:
        cooldown.restore(spark, before)
    changes = spark.read.parquet(f"{tmp_path}/out/*")
    rows = sorted((r.p, r.until.isoformat(" "), r.strikes, r.state) for r in changes.collect())
    assert rows == [
        ("a", "2024-01-01 00:45:00", 0, "free"), ("a", "2024-01-01 00:45:00", 1, "cooling"), ("a", "2024-01-01 01:00:00", 1, "cooling"),
        ("b", "2024-01-01 00:00:10", 0, "cooling"), ("b", "2024-01-01 00:00:10", 0, "free"),
        ("c", "2024-01-02 00:00:02", 3, "quarantined"),
        ("z", "2024-01-01 00:40:10", 0, "cooling"), ("z", "2024-01-01 00:40:10", 0, "free"), ("z", "2024-01-01 03:00:10", 0, "cooling"),
    ]
    last = {r.p: r.state for r in cooldown.last_states(changes, "p").collect()}
    assert last == {"a": "free", "b": "free", "c": "quarantined", "z": "cooling"}
