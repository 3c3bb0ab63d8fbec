from collections import Counter

import pytest
from pyspark.sql import functions as F

from noticeflow.llm import sharding


@pytest.fixture()
def docs(spark):
    text = F.when(F.col("id") % 50 == 0, None).otherwise(F.repeat(F.sha2(F.col("id").cast("string"), 256), (F.col("id") % 30).cast("int")))
    return spark.range(3000).select(F.when(F.col("id") % 97 == 0, None).otherwise(F.col("id") % 2500).alias("doc_id"), text.alias("text"), F.lit("x").alias("file"))


def test_appends_compact_to_target_sizes(spark, docs, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", target_bytes=200_000)
    for part in range(3):
        store.append(docs.where(F.pmod(F.xxhash64("text"), F.lit(3)) == part).repartition(9), 40)
    version, before = store.manifest()
    assert version == 3 and len(before) > 60
    rows = Counter(map(tuple, docs.collect()))
    assert Counter(map(tuple, store.read(docs.schema).collect())) == rows
    last = store.compact(docs.schema)
    after = store.manifest()[1]
    assert last > version and len(after) < len(before) / 4 and store.runs(after, store.least_run) == []
    assert max(s.bytes for s in after) < 2 * store.target and sum(s.rows for s in after) == 3000
    assert Counter(map(tuple, store.read(docs.schema).collect())) == rows
    assert Counter(map(tuple, store.read(docs.schema, 3).collect())) == rows  # the old version is still whole
    assert store.compact(docs.schema) == last
    assert store.vacuum() >= len({s.file for s in before} - {s.file for s in after})
    assert {str(p.relative_to(tmp_path / "s")) for p in tmp_path.glob("s/data/*/part-*")} == {s.file for s in after}
    assert Counter(map(tuple, store.read(docs.schema).collect())) == rows


def test_only_one_writer_commits_a_version(spark, docs, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s")
    store.append(docs)
    version, shards = store.manifest()
    store.commit(version, shards)
    with pytest.raises(sharding.Conflict):
        store.commit(version, [])
    assert store.manifest() == (version + 1, sorted(shards))


def test_runs_are_of_similar_size(spark):
    store = sharding.ShardStore(spark, "file:///nowhere", target_bytes=1000)
    small = [sharding.Shard(f"a{i}", 3, 1) for i in range(5)]
    large = [sharding.Shard(f"b{i}", 300, 1) for i in range(5)]
    full = [sharding.Shard("c", 900, 1)]
    runs = store.runs(small + large + full, 4)
    assert [sorted({s.bytes for s in r}) for r in runs] == [[3], [300]] and sum(s.bytes for s in runs[1]) <= 1250


def test_rows_come_back(spark, docs):
    import hashlib

    got = sharding.stored(docs, target_bytes=300_000)
    want = Counter((r.doc_id, r.file, None if r.text is None else hashlib.sha256(r.text.encode()).hexdigest()) for r in docs.collect())
    assert Counter((r.doc_id, r.file, r.text_sha256) for r in got.collect()) == want
    assert sharding.stored(docs.limit(0)).count() == 0


def test_vacuum_spares_another_writer(spark, docs, tmp_path):
    """What a second writer has written and not yet committed stays, and its commit is whole."""
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s")
    for part in range(5):
        store.append(docs.where(F.pmod(F.xxhash64("text"), F.lit(5)) == part).coalesce(1))
    folder = "data/other"
    with store.registered(folder):
        docs.limit(7).write.parquet(f"file://{tmp_path}/s/{folder}")
        store.compact(docs.schema)
        assert store.vacuum() == 5
        new = store._written(folder)
        version, shards = store.manifest()
        store.commit(version, shards + new)
    assert store.vacuum() == 0 and store.read(docs.schema).count() == 3007
    # a folder nobody registered, written after the newest version, stays as well
    docs.limit(3).write.parquet(f"file://{tmp_path}/s/data/late")
    assert store.vacuum() == 0
    late = store._written("data/late")
    for f in (tmp_path / "s" / "data" / "late").glob("part-*"):
        f.unlink()
    with pytest.raises(FileNotFoundError):
        store.commit(*(lambda v, s: (v, s + late))(*store.manifest()))
    assert store.read(docs.schema).count() == 3007


def test_concurrent_appends_and_compaction(spark, docs, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    root = f"file://{tmp_path}/s"
    one = docs.coalesce(1)

    def work(k):
        store = sharding.ShardStore(spark, root)
        store.append(one, 1000)
        if k % 2:
            store.compact(docs.schema)
            store.vacuum(keep=50)

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(work, range(4)))
    store = sharding.ShardStore(spark, root)
    assert store.read(docs.schema).count() == 12000 == sum(s.rows for s in store.manifest()[1])


def test_large_shards_are_cut(spark, docs, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", target_bytes=20_000)
    store.append(docs.coalesce(1))
    assert len(store.manifest()[1]) == 1 and store.manifest()[1][0].bytes > 2 * store.target
    store.compact(docs.schema)
    assert max(s.bytes for s in store.manifest()[1]) <= 2 * store.target
    assert Counter(map(tuple, store.read(docs.schema).collect())) == Counter(map(tuple, docs.collect()))


def test_places(spark, docs):
    got = sharding.stored(docs, target_bytes=60_000)
    own = {(r.shard, r.tier, r.manifest_version, r.runs_left) for r in got.select("shard", "tier", "manifest_version", "runs_left").collect()}
    assert len(own) > 1 and {x[3] for x in own} == {0} and all(x[2] >= 2 and x[1] >= 1 for x in own)


def test_names_that_are_taken_stay(spark):
    rows = [(i, f"t{i}", f"mine{i}", i, "v", None, "d") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, tier int, manifest_version string, runs_left int, text_sha256 string")
    got = sharding.stored(docs)
    assert got.columns == ["doc_id", "shard", "tier", "manifest_version", "runs_left", "text_sha256", "_shard", "_tier", "_manifest_version", "_runs_left", "_text_sha256"]
    assert sorted((r.doc_id, r.shard, r.tier, r.manifest_version, r.runs_left, r.text_sha256) for r in got.collect()) == [(r[0], r[2], r[3], r[4], r[5], r[6]) for r in rows]


def test_arrivals_meet_in_several_rounds(spark):
    docs = spark.createDataFrame([(i, f"{i} " * (i % 50)) for i in range(6000)], "doc_id long, text string")
    store = sharding.arrivals_to_store(docs)
    version, shards = store.manifest()
    assert version > len(sharding.ARRIVALS) + 1  # more than one round of merges
    assert not store.runs(shards, store.least_run) and sum(s.rows for s in shards) == 6000
