"""Versioned artifacts: what a manifest names is what was written, and a failed job is no version."""

import hashlib
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from noticeflow.sources import artifacts

NAMES = ["manifest", "health", "bids", "news", "rnd-announces", "rnd-outcomes", "patents", "trends", "favorites"]


def rows(spark, per=50):
    df = spark.range(len(NAMES) * per).select(F.element_at(F.array(*map(F.lit, NAMES)), (F.col("id") % len(NAMES) + 1).cast("int")).alias("artifact"), F.col("id").alias("position"))
    return df.withColumn("record", F.to_json(F.struct(F.col("position").alias("n"), F.lit("값").alias("v")))).withColumn("extra", F.lit(1))


def test_nine_files_read_back(spark, tmp_path):
    path = f"file://{tmp_path}/x"
    artifacts.export(rows(spark), path, "7")
    manifest = json.loads((tmp_path / "x/manifests/7.json").read_text())
    assert {p["artifact"] for p in manifest["parts"]} == set(NAMES) and sum(p["rows"] for p in manifest["parts"]) == 450
    for p in manifest["parts"]:
        data = (tmp_path / "x" / p["file"]).read_bytes()
        assert (len(data), hashlib.sha256(data).hexdigest(), data.count(b"\n")) == (p["bytes"], p["sha256"], p["rows"])
    for name in NAMES:
        lines = [json.loads(x)["n"] for p in manifest["parts"] if p["artifact"] == name for x in (tmp_path / "x" / p["file"]).read_text().splitlines()]
        assert lines == sorted(lines) and len(lines) == 50
    assert {r.artifact: (r.rows, r.intact) for r in artifacts.audited(spark, path, "7").collect()} == {n: (50, True) for n in NAMES}
    back = sorted((r.artifact, r.record) for r in artifacts.records(spark, path, "7").collect())
    assert back == sorted((r.artifact, r.record) for r in rows(spark).collect())


def test_versions_do_not_mix_and_are_written_once(spark, tmp_path):
    path = f"file://{tmp_path}/x"
    artifacts.export(rows(spark, 3), path, "1")
    artifacts.export(rows(spark, 2), path, "2")
    assert artifacts.records(spark, path, "1").count() == 27 and artifacts.records(spark, path, "2").count() == 18
    with pytest.raises(Exception, match="VersionExists"):
        artifacts.export(rows(spark, 2), path, "1")
    assert artifacts.records(spark, path, "1").count() == 27


def test_a_failed_task_leaves_no_version(spark, tmp_path):
    path = f"file://{tmp_path}/x"
    bad = rows(spark).withColumn("record", F.when(F.col("position") != 440, F.col("record")))
    with pytest.raises(Exception, match="(?i)null|abort"):
        artifacts.export(bad, path, "1")
    assert not list(Path(tmp_path).glob("x/manifests/*.json"))
    assert not list(Path(tmp_path).glob("x/parts/*.jsonl"))


def test_damage_is_seen(spark, tmp_path):
    path = f"file://{tmp_path}/x"
    artifacts.export(rows(spark, 5), path, "1")
    part = json.loads((tmp_path / "x/manifests/1.json").read_text())["parts"][0]
    for crc in (tmp_path / "x/parts").glob(".*.crc"):
        crc.unlink()
    (tmp_path / "x" / part["file"]).write_bytes(b"0" * part["bytes"])
    assert [r.artifact for r in artifacts.audited(spark, path, "1").where("not intact").collect()] == [part["artifact"]]
