"""Versioned artifacts: a data source whose tasks write parts and whose commit publishes one manifest.

``artifacts.write.format("artifact_export").options(path=.., version=..).mode("append").save()`` takes rows
(artifact, position, record): a record is a line of the artifact's files.  A task writes one part for each artifact it
meets, under a name of its own attempt, and reports its rows, bytes and SHA-256.  Only when all
tasks are done does the commit write ``manifests/<version>.json``, under another name first; nothing
is a version before that, and readers only follow manifests.  A failed job deletes what its
tasks had reported; what a lost task leaves behind is in no manifest.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .stores import open_store

MANIFEST = "version string, parts array<struct<artifact: string, first: long, file: string, rows: long, bytes: long, sha256: string>>"


class VersionExists(RuntimeError):
    """A version is written once."""


@dataclass
class Part:
    artifact: str
    first: int
    file: str
    rows: int
    bytes: int
    sha256: str


@dataclass
class Parts(WriterCommitMessage):
    parts: list[Part]


class ArtifactExport(DataSource):
    @classmethod
    def name(cls) -> str:
        return "artifact_export"

    def schema(self) -> str:
        return "artifact string, position long, record string"

    def writer(self, schema, overwrite: bool) -> ArtifactWriter:
        return ArtifactWriter(self.options["path"].rstrip("/"), self.options["version"])


class ArtifactWriter(DataSourceWriter):
    def __init__(self, path: str, version: str):
        self.path, self.version = path, version
        if exists(f"{path}/manifests/{version}.json"):
            raise VersionExists(version)

    def write(self, rows: Iterator) -> Parts:
        """Rows of an artifact that do not stand together become several parts."""
        store, root = open_store(self.path)
        done, out, part, digest = [], None, None, None
        try:
            for row in rows:
                if row.artifact is None or row.record is None:
                    raise ValueError("artifact and record must not be null")
                if part is None or part.artifact != row.artifact:
                    if out is not None:
                        out.close()
                        part.sha256 = digest.hexdigest()
                    name = f"parts/{uuid.uuid4().hex}.jsonl"
                    store.create_dir(f"{root}/parts", recursive=True)
                    part, digest = Part(row.artifact, row.position or 0, name, 0, 0, ""), hashlib.sha256()
                    done.append(part)
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                line = row.record.encode() + b"\n"
                out.write(line)
                digest.update(line)
                part.rows, part.bytes = part.rows + 1, part.bytes + len(line)
            if out is not None:
                out.close()
                part.sha256 = digest.hexdigest()
        except BaseException:
            remove(self.path, [p.file for p in done])
            raise
        return Parts(done)

    def commit(self, messages: Sequence[Parts | None]) -> None:
        parts = sorted((p for m in messages if m for p in m.parts), key=lambda p: (p.artifact, p.first, p.file))
        store, root = open_store(self.path)
        final, temporary = f"{root}/manifests/{self.version}.json", f"{root}/manifests/.{uuid.uuid4().hex}"
        store.create_dir(f"{root}/manifests", recursive=True)
        with store.open_output_stream(temporary, compression=None) as out:
            out.write(json.dumps({"version": self.version, "parts": [asdict(p) for p in parts]}, ensure_ascii=False).encode())
        if exists(f"{self.path}/manifests/{self.version}.json"):
            store.delete_file(temporary)
            remove(self.path, [p.file for p in parts])
            raise VersionExists(self.version)
        store.move(temporary, final)

    def abort(self, messages: Sequence[Parts | None]) -> None:
        remove(self.path, [p.file for m in messages if m for p in m.parts])


def exists(path: str) -> bool:
    from pyarrow import fs

    store, name = open_store(path)
    return store.get_file_info(name).type != fs.FileType.NotFound


def remove(path: str, files: Sequence[str]) -> None:
    store, root = open_store(path)
    for f in files:
        if exists(f"{path}/{f}"):
            store.delete_file(f"{root}/{f}")


def export(rows: DataFrame, path: str, version: str) -> None:
    """Publishes (artifact, position, record) as a version; every artifact's lines are in the order of position.

    Rows are dealt out by artifact and ranges of position, so that a large artifact has several parts.
    """
    spark = rows.sparkSession
    spark.dataSource.register(ArtifactExport)
    dealt = rows.select("artifact", F.col("position").cast("long").alias("position"), "record").repartitionByRange("artifact", "position")
    dealt.sortWithinPartitions("artifact", "position").write.format("artifact_export").options(path=path, version=version).mode("append").save()


def manifest(spark: SparkSession, path: str, version: str) -> DataFrame:
    """The parts of a version, in order: artifact, first, file, rows, bytes, sha256."""
    read = spark.read.schema(MANIFEST).option("multiLine", True).json(f"{path}/manifests/{version}.json")
    return read.select(F.explode("parts").alias("p")).select("p.*")


def audited(spark: SparkSession, path: str, version: str) -> DataFrame:
    """Per artifact: parts, rows and bytes by the manifest, and ``intact``, whether all files are there with their digests."""
    files = spark.read.format("binaryFile").load(f"{path}/parts").select(
        F.regexp_extract("path", r"(parts/[^/]+)$", 1).alias("file"), F.sha2("content", 256).alias("found"), "length"
    )
    both = manifest(spark, path, version).join(files, "file", "left")
    same = F.coalesce((F.col("found") == F.col("sha256")) & (F.col("length") == F.col("bytes")), F.lit(False))
    return both.groupBy("artifact").agg(
        F.count(F.lit(1)).alias("parts"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"), F.bool_and(same).alias("intact")
    )


def records(spark: SparkSession, path: str, version: str) -> DataFrame:
    """(artifact, record) of a version, from the files that its manifest names."""
    lines = spark.read.text(f"{path}/parts").select(F.regexp_extract(F.col("_metadata.file_path"), r"(parts/[^/]+)$", 1).alias("file"), F.col("value").alias("record"))
    return lines.join(manifest(spark, path, version).select("file", "artifact"), "file").select("artifact", "record")
