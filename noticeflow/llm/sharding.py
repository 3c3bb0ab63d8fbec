"""Sharded store with size-tiered compaction (DataFrame functions only).

Arrivals are appended as small immutable Parquet shards.  A manifest lists the shards of a version;
the versions are numbered, and the highest one is the store.  Compaction takes the shards below the
target size, sorts them into tiers of similar size, and merges runs of a tier into files of about
the target size, each by one task that reads only its own run, so nothing is shuffled.  The new
manifest is written in full beside the old ones and then renamed to its number: the rename fails if
that number exists, so of two writers one wins and the other starts again from the new version.  That
needs a store whose rename is atomic and does not replace, as HDFS's is; local folders, as in tests,
have it but for an instant between two writers, and plain object stores do not have it.  Shards far
above the target are cut.  Readers keep the version they began with.

A writer registers its folder under ``pending`` before it writes and until it has committed.
``vacuum`` removes files that no kept version lists and whose folder nobody has registered; ``commit``
refuses shards that are not there.
"""

from __future__ import annotations

import json
import math
import random
import time
import uuid
from contextlib import contextmanager
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, free_name, hadoop_path

TARGET_BYTES, TIER_BASE, LEAST_RUN = 128 << 20, 4, 4
#: Merges that are planned in one job; each is one task.
JOB_MERGES = 1024
#: Tries of a commit before an append gives up; registrations older than so many seconds are of dead writers.
TRIES, PENDING_SECONDS = 20, 7 * 86400


@dataclass(frozen=True, order=True)
class Shard:
    file: str
    bytes: int
    rows: int


class Conflict(RuntimeError):
    """Another writer committed this version first."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, base: int = TIER_BASE, least_run: int = LEAST_RUN):
        self.spark, self.root = spark, root.rstrip("/")
        self.target, self.base, self.least_run = target_bytes, base, least_run

    # manifests: metadata only, through Hadoop's file system

    def versions(self) -> list[int]:
        fs, p = hadoop_path(self.spark, f"{self.root}/manifest")
        if not fs.exists(p):
            return []
        return sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(p) if s.getPath().getName()[0] == "v")

    def manifest(self, version: int | None = None) -> tuple[int, list[Shard]]:
        version = max(self.versions(), default=0) if version is None else version
        if version == 0:
            return 0, []
        fs, p = hadoop_path(self.spark, f"{self.root}/manifest/v{version:08d}")
        stream = fs.open(p)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return version, [Shard(**json.loads(x)) for x in text.splitlines()]

    @contextmanager
    def registered(self, folder: str):
        """Keeps a folder of ``data`` from ``vacuum`` while a writer fills and commits it."""
        fs, mark = hadoop_path(self.spark, f"{self.root}/pending/{folder.split('/')[-1]}")
        fs.create(mark, True).close()
        try:
            yield
        finally:
            fs.delete(mark, False)

    def pending(self) -> set[str]:
        fs, p = hadoop_path(self.spark, f"{self.root}/pending")
        oldest = (time.time() - PENDING_SECONDS) * 1000
        return {s.getPath().getName() for s in (fs.listStatus(p) if fs.exists(p) else []) if s.getModificationTime() >= oldest}

    def commit(self, version: int, shards: list[Shard]) -> int:
        """Publishes the shards as version + 1; raises Conflict, or FileNotFoundError for shards that are not there."""
        fs, to = hadoop_path(self.spark, f"{self.root}/manifest/v{version + 1:08d}")
        new = {s.file for s in shards} - {s.file for s in self.manifest(version)[1]}
        for folder in {f.rpartition("/")[0] for f in new}:
            _, p = hadoop_path(self.spark, f"{self.root}/{folder}")
            there = {f"{folder}/{s.getPath().getName()}" for s in (fs.listStatus(p) if fs.exists(p) else [])}
            if lost := {f for f in new if f.rpartition("/")[0] == folder} - there:
                raise FileNotFoundError(f"shards are gone: {sorted(lost)[:3]}")
        _, tmp = hadoop_path(self.spark, f"{self.root}/manifest/_{uuid.uuid4().hex}")
        stream = fs.create(tmp, False)
        stream.write("\n".join(json.dumps(asdict(s)) for s in sorted(shards)).encode())
        stream.close()
        if fs.exists(to) or not fs.rename(tmp, to):
            fs.delete(tmp, False)
            raise Conflict(f"version {version + 1} exists")
        return version + 1

    # data

    def read(self, schema, version: int | None = None) -> DataFrame:
        _, shards = self.manifest(version)
        if not shards:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{s.file}" for s in shards])

    def _written(self, folder: str) -> list[Shard]:
        """The shards in a folder that a job has finished, with their sizes and rows."""
        fs, p = hadoop_path(self.spark, f"{self.root}/{folder}")
        sizes = {s.getPath().getName(): s.getLen() for s in fs.listStatus(p) if s.getPath().getName().startswith("part-")}
        counts = self.spark.read.parquet(f"{self.root}/{folder}").groupBy(F.col("_metadata.file_name").alias("f")).count() if sizes else None
        rows = {r.f: r["count"] for r in counts.collect()} if counts is not None else {}
        return [Shard(f"{folder}/{n}", b, rows[n]) for n, b in sizes.items() if rows.get(n)]

    def append(self, df: DataFrame, shard_rows: int = 0) -> int:
        """Adds the rows as new shards: one per task, or of at most ``shard_rows`` rows."""
        folder = f"data/{uuid.uuid4().hex}"
        with self.registered(folder):
            df.write.option("maxRecordsPerFile", shard_rows).parquet(f"{self.root}/{folder}")
            new = self._written(folder)
            for n in range(TRIES):
                version, shards = self.manifest()
                try:
                    return self.commit(version, shards + new)
                except Conflict:
                    time.sleep(random.uniform(0, 0.05 * 2 ** min(n, 6)))
        raise Conflict(f"{TRIES} commits of an append were overtaken")

    def tier(self, size: int) -> int:
        """0 for the smallest; each tier holds sizes up to ``base`` times the last."""
        return max(0, math.ceil(math.log(max(size, 1) / (self.target / self.base**4), self.base)))

    def runs(self, shards: list[Shard], least: int) -> list[list[Shard]]:
        """Runs of similar size to merge: consecutive shards of a tier up to the target size."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if s.bytes < self.target * 3 // 4:
                tiers.setdefault(self.tier(s.bytes), []).append(s)
        out = []
        for _, members in sorted(tiers.items()):
            run, size = [], 0
            for s in sorted(members, key=lambda s: (s.bytes, s.file)):
                if run and size + s.bytes > self.target * 5 // 4:
                    out.append(run)
                    run, size = [], 0
                run.append(s)
                size += s.bytes
            out.append(run)
        return [r for r in out if len(r) >= least or sum(s.bytes for s in r) >= self.target * 3 // 4 and len(r) > 1]

    def _replace(self, version: int, shards: list[Shard], gone: set[Shard], df: DataFrame, shard_rows: int = 0) -> None:
        """Writes the rows of the shards that go as new ones and commits; overtaken, it leaves the store as it is."""
        folder = f"data/{uuid.uuid4().hex}"
        with self.registered(folder):
            df.write.option("maxRecordsPerFile", shard_rows).parquet(f"{self.root}/{folder}")
            new = self._written(folder)
            if sum(s.rows for s in new) != sum(s.rows for s in gone):
                raise RuntimeError("a merge changed the number of rows")
            try:
                self.commit(version, [s for s in shards if s not in gone] + new)
            except Conflict:
                pass  # the new files are in no manifest; the next round starts from the new version

    def compact(self, schema, vacuum: bool = False) -> int:
        """Cuts shards above twice the target and merges until no tier has a run to merge; returns the version then.

        With ``vacuum`` what a round has replaced is removed before the next: for stores that nobody
        reads yet, so that they never hold more than two copies.

        Only the manifest of file sizes is planned on the driver.  Each merge is one task over one
        run of at most 5/4 of the target size; the merges of a round are one job.
        """
        rows_of = lambda own: self.spark.read.schema(schema).parquet(*[f"{self.root}/{s.file}" for s in own])
        while True:
            if vacuum:
                self.vacuum()
            version, shards = self.manifest()
            large = [s for s in shards if s.bytes > 2 * self.target and s.rows > 1]
            if large:
                # all at once; the widest rows set the rows of a file
                self._replace(version, shards, set(large), rows_of(large), min(max(1, s.rows * self.target // s.bytes) for s in large))
                continue
            chosen = self.runs(shards, self.least_run)[:JOB_MERGES]
            if not chosen:
                return version
            parts = [rows_of(run).coalesce(1) for run in chosen]
            merged = parts[0]
            for p in parts[1:]:
                merged = merged.unionAll(p)
            self._replace(version, shards, {s for run in chosen for s in run}, merged)

    def vacuum(self, keep: int = 1, grace_seconds: float = 0) -> int:
        """Removes shard files that none of the last ``keep`` versions lists; returns their number.

        Files in registered folders stay, and so do files younger than ``grace_seconds`` or than the
        newest version: what is written after it may be about to be committed.
        """
        waiting = self.pending()  # before the manifests: what is committed meanwhile is in one of both
        versions = self.versions()[-keep:]
        kept = {s.file for v in versions for s in self.manifest(v)[1]}
        fs, p = hadoop_path(self.spark, f"{self.root}/data")
        if not versions or not fs.exists(p):
            return 0
        _, newest = hadoop_path(self.spark, f"{self.root}/manifest/v{versions[-1]:08d}")
        before = min(fs.getFileStatus(newest).getModificationTime(), (time.time() - grace_seconds) * 1000)
        removed = 0
        for folder in fs.listStatus(p):
            name = folder.getPath().getName()
            for f in fs.listStatus(folder.getPath()) if name not in waiting else []:
                file = f.getPath().getName()
                if file.startswith("part-") and f"data/{name}/{file}" not in kept and f.getModificationTime() <= before:
                    fs.delete(f.getPath(), False)
                    removed += 1
        return removed


#: Arrivals of a store made from one table: shares of its rows, each with the number of shards it comes
#: in at least; rows of a shard at most; the target of a store as a share of it, where that is less than ``TARGET_BYTES``.
ARRIVALS, ARRIVING_ROWS, TARGET_SHARE = ((1, 64), (3, 48), (12, 24)), 4096, 8


def arrivals_to_store(docs: DataFrame, shard_rows: int | None = None, target_bytes: int | None = None, **options) -> ShardStore:
    """A store in the shared folder with the rows of ``docs``, appended in batches of unlike size and compacted.

    Batches are dealt by a hash of the whole row: a sixteenth of the rows comes in the smallest shards, three in larger ones,
    the rest in the largest, so that merges of small shards meet those of the tiers above.
    """
    spark = docs.sparkSession
    store = ShardStore(spark, f"{Scratch(spark, 'sharding').root}/store", target_bytes or TARGET_BYTES, **options)
    rows, whole = docs.count(), sum(share for share, _ in ARRIVALS)
    place, begin = F.pmod(F.xxhash64(*docs.columns), F.lit(whole)), 0
    for share, shards in ARRIVALS:
        own = shard_rows or max(1, min(ARRIVING_ROWS, -(-rows * share // whole // shards)))
        store.append(docs.where((place >= begin) & (place < begin + share)), own)
        begin += share
    if target_bytes is None:
        store.target = min(TARGET_BYTES, max(1, sum(s.bytes for s in store.manifest()[1]) // TARGET_SHARE))
    store.compact(docs.schema, vacuum=True)
    return store


def placed(store: ShardStore, schema) -> DataFrame:
    """The rows of a store with ``shard`` (its file), ``tier``, ``manifest_version`` and ``runs_left`` to merge.

    Where the rows have columns of these names, underscores are put before the new ones.
    """
    version, shards = store.manifest()
    back = store.read(schema, version)
    left = len(store.runs(shards, store.least_run))
    size = F.col("_metadata.file_size").cast("double")
    # as ``tier`` does it; a file's size is in its own metadata, so no list of shards is joined
    tier = F.greatest(F.lit(0), F.ceil(F.log(F.greatest(size, F.lit(1.0)) / (store.target / store.base**4)) / math.log(store.base))).cast("int")
    shard = F.element_at(F.split("_metadata.file_path", "/data/"), -1)
    extra = {"shard": shard, "tier": tier} if shards else {"shard": F.lit(""), "tier": F.lit(0)}
    extra |= {"manifest_version": F.lit(version).cast("long"), "runs_left": F.lit(left).cast("long")}
    return back.withColumns({free_name(back, k): v for k, v in extra.items()})


def stored(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` as read back from a compacted store: other columns, then ``text_sha256``, and where they lie.

    ``shard``, ``tier``, ``manifest_version`` and ``runs_left`` are those of ``placed``.

    Every row is stored once, repeated rows as often as they come, nulls as nulls, texts whole.  A
    null text has a null digest.  An empty table gives a store without shards and no rows.  Columns
    keep their names and values; new ones get underscores before them where a name is taken.
    """
    store = arrivals_to_store(docs, **options)
    back = placed(store, docs.schema)
    return back.withColumn(free_name(back, "text_sha256"), F.sha2(F.col(text), 256)).drop(text)
