"""Packed line files as a data source: every line or its refusal a row, and a row of figures for every file.

``spark.read.format("packed_lines").options(path=.., max_line=.., max_packed=.., max_raw=..).load()``.  A file
is one task's, since packed streams have no places to begin at; it is read once, in parts of bounded size, also
where it has several members.  Rows have ``kind``: ``line``; ``rejected``, for a line over ``max_line`` bytes (its content is
passed over, not held) or one that is no UTF-8; ``file``, last, with packed and raw bytes, lines, rejected lines, the
SHA-256 of the packed bytes that were read, and in ``reason`` what ended the reading before the end: packed_limit, raw_limit, damaged or cut_off.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .stores import open_store

#: Bytes of a line, of a packed and of an unpacked file at most.
MAX_LINE, MAX_PACKED, MAX_RAW = 8 << 20, 2 << 30, 8 << 30
#: Bytes of one read, and of one step of unpacking.
READ, STEP = 1 << 20, 1 << 18


@dataclass
class PackedFile(InputPartition):
    path: str


class PackedLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "packed_lines"

    def schema(self) -> str:
        return "file string, kind string, number long, line string, reason string, packed_bytes long, raw_bytes long, lines long, rejected long, sha256 string"

    def reader(self, schema) -> PackedReader:
        return PackedReader(self.options)


class PackedReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"].rstrip("/")
        self.max_line, self.max_packed, self.max_raw = (int(options.get(k, d)) for k, d in (("max_line", MAX_LINE), ("max_packed", MAX_PACKED), ("max_raw", MAX_RAW)))

    def partitions(self) -> list[PackedFile]:
        from pyarrow import fs

        store, root = open_store(self.path)
        if store.get_file_info(root).type == fs.FileType.File:
            return [PackedFile(self.path)]
        found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return [PackedFile(f"{self.path}/{f.base_name}") for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and f.base_name[0] not in "._"]

    def read(self, part: PackedFile) -> Iterator[tuple]:
        scan = Scan(part.path, self.max_packed, self.max_raw)
        held, number, rejected, over = b"", 0, 0, 0

        def row(line: bytes, size: int) -> tuple:
            if size > self.max_line:
                return part.path, "rejected", number, None, f"line of {size} bytes", None, None, None, None, None
            try:
                return part.path, "line", number, line.decode(), None, None, None, None, None, None
            except UnicodeDecodeError:
                return part.path, "rejected", number, None, "no UTF-8", None, None, None, None, None

        for data in scan.parts():
            *whole, rest = data.split(b"\n")
            for piece in whole:
                line, size = held + piece, over + len(held) + len(piece)
                held, over = b"", 0
                number += 1
                out = row(line, size)
                rejected += out[1] == "rejected"
                yield out
            held += rest
            if len(held) > self.max_line:  # passed over, but counted
                over, held = over + len(held), b""
        if held or over:
            number += 1
            out = row(held, over + len(held))
            rejected += out[1] == "rejected"
            yield out
        yield part.path, "file", None, None, scan.reason, scan.packed, scan.raw, number, rejected, scan.digest.hexdigest()


class Scan:
    """Unpacks a gzip file part by part, counting and digesting what it reads."""

    def __init__(self, path: str, max_packed: int, max_raw: int):
        self.path, self.max_packed, self.max_raw = path, max_packed, max_raw
        self.packed, self.raw, self.digest, self.reason = 0, 0, hashlib.sha256(), None

    def parts(self) -> Iterator[bytes]:
        store, name = open_store(self.path)
        member, fresh = zlib.decompressobj(31), True
        with store.open_input_stream(name, compression=None) as f:
            while data := f.read(READ):
                if self.packed + len(data) > self.max_packed:
                    self.reason = "packed_limit"
                    return
                self.packed += len(data)
                self.digest.update(data)
                while data:
                    try:
                        out = member.decompress(data, STEP)
                    except zlib.error:
                        self.reason = "damaged"
                        return
                    fresh = False
                    if self.raw + len(out) > self.max_raw:
                        self.reason = "raw_limit"
                        return
                    self.raw += len(out)
                    if out:
                        yield out
                    data = member.unconsumed_tail
                    if member.eof:
                        data, member, fresh = member.unused_data, zlib.decompressobj(31), True
        if not fresh:
            self.reason = "cut_off"


def file_figures(rows: DataFrame) -> DataFrame:
    """Per file: lines, rejected ones, bytes, digest and what ended its reading; ``held`` tells whether the counts are those of its rows."""
    counted = rows.groupBy("file").agg(
        F.count_if(F.col("kind") != "file").alias("_lines"), F.count_if(F.col("kind") == "rejected").alias("_rejected"),
        *[F.max(F.when(F.col("kind") == "file", F.col(c))).alias(c) for c in ("packed_bytes", "raw_bytes", "lines", "rejected", "sha256", "reason")],
    )
    return counted.withColumn("held", (F.col("_lines") == F.col("lines")) & (F.col("_rejected") == F.col("rejected"))).drop("_lines", "_rejected")
