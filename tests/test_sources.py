import json

from pyspark.sql import functions as F

from noticeflow.operators import joins
from noticeflow.sources import readers, writers
from noticeflow.sources.recorded_api import NoticeApi
from noticeflow.streaming import streams


def test_csv_items(spark, tmp_path):
    (tmp_path / "i.csv").write_text('source_type,source_name,title,organization,posted_at,due_at,amount,region,keywords,summary,url,relevance_score\nbid,G,"a ""b"", c",,2024-01-02,,100,,x;y,,http://x,9.5\n')
    r = readers.csv_items(spark, str(tmp_path)).first()
    assert (r.title, r.organization, str(r.posted_at), r.due_at, r.amount, r.is_sample) == ('a "b", c', "", "2024-01-02", None, 100, True)


def test_json_lines_counts_broken_ones(spark, tmp_path):
    import gzip

    lines = ['{"url": "a", "n": 1}', "not json", '{"n": 2}', '{"url": " ", "n": 3}']
    with gzip.open(tmp_path / "x.json.gz", "wt") as f:
        f.write("\n".join(lines))
    df = readers.json_lines(spark, str(tmp_path), "url string, n int", ["url"])
    assert sorted((r.n or 0, r.malformed) for r in df.collect()) == [(0, True), (1, False), (2, True), (3, True)]
    assert df.first().file.endswith("x.json.gz")


def test_json_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": "1"}, {"id": "2"}], indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"count": 1, "items": [{"id": "3"}]}))
    assert sorted(r.id for r in readers.json_items(spark, str(tmp_path), "id string").collect()) == ["1", "2", "3"]


def test_xml_and_html(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<r><items><item><no>1</no><t>x</t></item><item><no>2</no></item></items></r>")
    assert sorted((r.no, r.t) for r in readers.xml_items(spark, str(tmp_path / "a.xml"), "item", "no int, t string").collect()) == [(1, "x"), (2, None)]
    (tmp_path / "p.html").write_text("<title>a\nb</title>")
    assert readers.html_pages(spark, str(tmp_path / "p.html")).first().html == "<title>a\nb</title>"


def test_manifest_keeps_missing_samples(spark):
    manifest = spark.createDataFrame([("a", True), ("b", True), ("c", False)], "sample string, enabled boolean")
    found = spark.createDataFrame([("a", 1), ("c", 2)], "sample string, n int")
    out = readers.by_manifest(manifest, found, "sample")
    assert sorted((r.sample, r.n, r.missing) for r in out.collect()) == [("a", 1, False), ("b", None, True)]


def test_snapshots(spark, tmp_path):
    import pytest

    df = spark.range(3).select(F.col("id"), F.lit("x").alias("t"))
    path = f"file://{tmp_path}/s"
    writers.next_snapshot(df, path, 1)
    writers.next_snapshot(df.limit(1), path, 2)
    with pytest.raises(Exception, match="(?i)exists"):
        writers.next_snapshot(df, path, 2)
    assert tuple(readers.largest_version(readers.snapshots(spark, path)).first()) == (1, 3)
    document = json.loads(writers.json_document(df.withColumn("none", F.lit(None).cast("int")), 2).first().document)
    assert document["count"] == 2 and document["items"][0] == {"id": 0, "t": "x", "none": None}


def test_recorded_api(spark, tmp_path):
    (tmp_path / "bid_2024-01-01_1.json").write_text(json.dumps({"items": [{"no": 1}, {"no": 2}]}))
    (tmp_path / "bid_2024-01-01_2.json").write_text(json.dumps([{"no": 3}]))
    (tmp_path / "bid_2024-01-08_1.json").write_text(json.dumps({"items": {"no": 4}}))
    spark.dataSource.register(NoticeApi)
    df = spark.read.format("notice_api").option("folder", str(tmp_path)).option("start", "2024-01-01").option("end", "2024-01-10").option("categories", "bid,plan").load()
    assert sorted((r.begin, r.page, json.loads(r.record)["no"]) for r in df.collect()) == [("2024-01-01", 1, 1), ("2024-01-01", 1, 2), ("2024-01-01", 2, 3), ("2024-01-08", 1, 4)]


def test_stream_upserts_and_strikes(spark, tmp_path):
    first = spark.createDataFrame([(1, "a", 1), (2, "z", 1), (2, "b", 2)], "id int, v string, at int")
    second = spark.createDataFrame([(2, "x", 3), (2, "c", 4), (3, "y", 3), (3, "d", 5)], "id int, v string, at int")
    for n, df in enumerate((first, second)):
        df.coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    run = streams.upsert_batches(f"{tmp_path}/out", ["id"], ["v"], ["at"])
    query = stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r.id, r.v) for r in spark.read.parquet(f"{tmp_path}/out/v=1").collect()) == [(1, "a"), (2, "c"), (3, "d")]

    log = spark.createDataFrame([("p", 1, 429), ("p", 2, 429), ("q", 1, 429), ("q", 2, 200), ("q", 3, 500)], "p string, at int, s int")
    log.coalesce(1).write.parquet(f"{tmp_path}/log/0")
    strikes = streams.provider_strikes(spark.readStream.schema(log.schema).parquet(f"{tmp_path}/log/*"), "p", "at", "s")
    streams.run_available(strikes, "strikes", "update", f"{tmp_path}/c2")
    assert sorted(map(tuple, spark.table("strikes").collect())) == [("p", 2, True), ("q", 0, False)]


def test_paced_client():
    from noticeflow.sources.paced import Answer, PacedClient, retry_after

    now, slept, script = [0.0], [], []

    def sleep(s):
        slept.append(round(s, 3))
        now[0] += s

    client = PacedClient(lambda url: script.pop(0), sleep, lambda: now[0], jitter=0)
    script[:] = [Answer(200, "a")]
    assert client.fetch("u").body == "a" and slept == []
    script[:] = [Answer(503), Answer(429, headers={"Retry-After": "5"}), Answer(200, "b")]
    assert client.fetch("u").attempts == 3 and slept == [12, 30, 5, 7] and not client.open
    script[:] = [Answer(429)] * 3
    assert client.fetch("u").status == 429 and client.open and client.fetch("u").status == 0
    assert retry_after("Thu, 01 Jan 1970 00:01:00 GMT", 0) == 60 and retry_after("soon", 0) is None


def test_url_builders(spark):
    from noticeflow.functions import identity, urls

    row = spark.createDataFrame([("R 1", None)], "r string, n string").select(
        urls.built("http://x/y", {"a": F.col("r"), "b": F.col("n"), "c": F.lit(2)}).alias("u"),
        urls.candidates(["/p", "/q"], ["no", "id"], F.col("r")).alias("c"), urls.candidates(["/p"], ["no"], F.col("n")).alias("none"),
        urls.page_verdict(F.lit(200), F.lit("Notice R 1 here"), F.col("r"), F.col("n"), ["not found"]).alias("v"),
    ).first()
    assert row.u == "http://x/y?a=R+1&c=2" and row.c == ["/p?no=R+1", "/p?id=R+1", "/q?no=R+1", "/q?id=R+1"] and row.none == [] and row.v == "verified"
    assert identity.fingerprint({"b": 1, "a": [2]}) == identity.fingerprint({"a": [2], "b": 1}) != identity.fingerprint({"a": [2]})
