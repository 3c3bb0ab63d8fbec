"""WARC archives: a writer with revisit records and a reader that salvages damaged archives.

Each record is a gzip member of its own.  The reader takes byte ranges of archives, so a large file
is shared by many tasks: a range owns the records that begin in it.  A record is accepted only if
its member unpacks with the right checksum, its version line and headers parse, its length fits and
its digests agree.  After any failed check the reader searches for the next place where a valid
member begins, or, in archives that are not compressed, the next version line, goes on there, and
logs the bytes in between as a quarantined gap with the reason.

Files are read and written in the tasks through pyarrow's file systems, so archives can lie in any
store it knows.  A task writes under a name of its own attempt and the names of finished files come
back with its rows; what a lost or repeated task leaves behind is in no list and never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.stores import open_store
from .common import BROADCAST_ROWS, Scratch, small_batches

VERSION = b"WARC/1.1"
#: Payloads of at least so many bytes are written once and revisited.
LEAST_REVISIT = 0
#: Target bytes of an archive, bytes of a read range, of one read from
#: the store and of one step within it.
ARCHIVE_BYTES, RANGE_BYTES, READ_BYTES, STEP_BYTES = 64 << 20, 32 << 20, 1 << 20, 1 << 14
MAGIC, LINE = b"\x1f\x8b\x08", re.compile(rb"WARC/1\.[01]\r\n")
WRITTEN = "path string, bytes long, records long"
READ = """path string, start long, end long, kind string, reason string, record_type string, record_id string,
 page_id long, url string, payload_digest string, payload_bytes long, refers_to long, payload binary"""


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def make_record(headers: dict[str, str], block: bytes) -> bytes:
    """One record as a gzip member."""
    head = [VERSION.decode()] + [f"{k}: {v}" for k, v in headers.items() if v is not None]
    head.append(f"Content-Length: {len(block)}")
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


def page_record(page_id, url: str | None, payload: bytes, refers_to, is_revisit: bool) -> bytes:
    """The response or revisit record of a page.  A revisit keeps the HTTP head, not the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if is_revisit else head + payload
    number = "" if page_id is None else str(page_id)
    headers = {
        "WARC-Type": "revisit" if is_revisit else "response",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, number + '|' + sha1_base32(payload))}>",
        "WARC-Date": "2024-01-01T00:00:00Z",
        "WARC-Target-URI": re.sub(r"[\r\n]+", " ", url) if url is not None else None,
        "WARC-Payload-Digest": "sha1:" + sha1_base32(payload),
        "WARC-Block-Digest": "sha1:" + sha1_base32(block),
        "Content-Type": "application/http; msgtype=response",
        "X-Page-ID": number,
    }
    if is_revisit:
        headers["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        headers["X-Refers-To-Page-ID"] = "" if refers_to is None else str(refers_to)
    return make_record(headers, block)


def assign_types(pages: DataFrame, id: str, payload: str, least: int = LEAST_REVISIT) -> DataFrame:
    """Adds ``refers_to`` (smallest id with that payload) and ``is_revisit``.

    Equal payloads meet by their SHA-256; only digests and ids are shuffled, and a frequent payload is
    one row per task after the first step.  The digests of payloads that occur more than once come
    back to the pages by a broadcast, so that payloads stay where they are; only if there are more
    than ``BROADCAST_ROWS`` of them does the join shuffle the pages.
    """
    scratch = Scratch(pages.sparkSession, "warc-types")
    key = F.unhex(F.sha2(F.coalesce(F.col(payload), F.lit("")), 256))
    firsts = pages.groupBy(key.alias("same")).agg(F.min(id).alias("first_id"), F.count(F.lit(1)).alias("pages"))
    firsts = scratch.keep(firsts.where("pages > 1").drop("pages"), "repeated")
    found = F.broadcast(firsts) if firsts.count() <= BROADCAST_ROWS else firsts
    out = pages.join(found, key == F.col("same"), "left")
    big = F.octet_length(F.coalesce(F.col(payload), F.lit(""))) >= least
    revisit = big & F.col("same").isNotNull() & ~F.col(id).eqNullSafe(F.col("first_id"))
    return out.select("*", revisit.alias("is_revisit"), F.when(revisit, F.col("first_id")).alias("refers_to")).drop("first_id", "same")


def write_archives(pages: DataFrame, folder: str, id: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """Writes a record per page; returns the finished archives (path, bytes, records)."""
    limit = ARCHIVE_BYTES

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = open_store(folder)
        out, name, size, count = None, "", 0, 0
        done = []
        for pdf in batches:
            for page_id, link, text, refers, revisit in zip(*(pdf[c].tolist() for c in ("id", "url", "payload", "refers_to", "is_revisit"))):
                if out is None:
                    store.create_dir(root, recursive=True)
                    name, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                record = page_record(page_id, link, (text or "").encode("utf-8", "surrogatepass"), refers, bool(revisit))
                out.write(record)
                size, count = size + len(record), count + 1
                if size >= limit:
                    out.close()
                    out = None
                    done.append((f"{folder}/{name}", size, count))
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", size, count))
        yield pd.DataFrame(done, columns=["path", "bytes", "records"])

    typed = assign_types(pages.select(F.col(id).alias("id"), F.col(url).alias("url"), F.col(payload).alias("payload")), "id", "payload", least)
    # ids as text: pandas would turn a column of integers with nulls into floats
    small_batches(pages.sparkSession)  # whole pages
    rows = typed.select(F.col("id").cast("string").alias("id"), "url", "payload", F.col("refers_to").cast("string").alias("refers_to"), "is_revisit")
    return rows.mapInPandas(write, WRITTEN)


class Damaged(Exception):
    pass


class Buffered:
    """Random access to a file through one buffered part of it."""

    def __init__(self, path: str):
        store, name = open_store(path)
        self.file = store.open_input_file(name)
        self.size, self.at, self.data = self.file.size(), 0, b""

    def get(self, start: int, length: int) -> bytes:
        """Exactly these bytes, fewer only at the end of the file."""
        length = min(length, self.size - start)
        if not self.at <= start or start + length > self.at + len(self.data):
            self.file.seek(start)
            self.at, self.data = start, self.file.read(max(length, READ_BYTES))
        return self.data[start - self.at : start - self.at + length]


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes, int]:
    """Headers in lower case, block, and the record's length; checks version, length and end."""
    if not LINE.match(raw):
        raise Damaged("no version line")
    head_end = raw.find(b"\r\n\r\n")
    if head_end < 0:
        raise Damaged("headers do not end")
    headers = {}
    for line in raw[:head_end].split(b"\r\n")[1:]:
        k, colon, v = line.partition(b":")
        if not colon:
            raise Damaged("header without a colon")
        headers[k.strip().lower().decode("utf-8", "replace")] = v.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not length.isdigit():
        raise Damaged("no content length")
    begin, end = head_end + 4, head_end + 4 + int(length)
    if raw[end : end + 4] != b"\r\n\r\n":
        raise Damaged("content length does not fit")
    return headers, raw[begin:end], end + 4


def verified(headers: dict[str, str], block: bytes) -> dict:
    """The fields of a parsed record, after its digests agree."""
    if (want := headers.get("warc-block-digest")) and want != "sha1:" + sha1_base32(block):
        raise Damaged("block digest differs")
    kind, payload = headers.get("warc-type"), None
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
    head, split, body = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?im)^content-length:\s*(\d+)", head)
    if kind == "response" and split:
        payload = body
        if digest and digest != sha1_base32(payload):
            raise Damaged("payload digest differs")
    number = lambda k: int(v) if re.fullmatch(r"-?\d+", v := headers.get(k, "")) else None
    return {
        "record_type": kind, "record_id": headers.get("warc-record-id"), "url": headers.get("warc-target-uri"),
        "page_id": number("x-page-id"), "refers_to": number("x-refers-to-page-id"), "payload_digest": digest,
        "payload_bytes": len(payload) if payload is not None else int(length[1]) if length else None, "payload": payload,
    }


def unpack_member(window: Buffered, start: int) -> tuple[bytes, int]:
    """Content and packed length of the gzip member at ``start``."""
    z, out, at = zlib.decompressobj(31), [], start
    while not z.eof:
        part = window.get(at, STEP_BYTES)
        if not part:
            raise Damaged("member is cut off")
        try:
            out.append(z.decompress(part))
        except zlib.error as e:
            raise Damaged("member does not unpack") from e
        at += len(part)
    return b"".join(out), at - len(z.unused_data) - start


def record_at(window: Buffered, start: int) -> tuple[dict, int]:
    """Fields and length in the file of the record that begins at ``start``."""
    if window.get(start, 3) == MAGIC:
        raw, packed = unpack_member(window, start)
        headers, block, used = parse_record(raw)
        if used != len(raw):
            raise Damaged("member holds more than a record")
        return verified(headers, block), packed
    if window.get(start, 5) != b"WARC/":
        raise Damaged("no member and no version line")
    size = STEP_BYTES
    while True:
        raw = window.get(start, size)
        try:
            headers, block, used = parse_record(raw)
            return verified(headers, block), used
        except Damaged as e:
            # a long record is read in growing parts, up to what its own header asks for
            length = re.search(rb"(?im)^content-length:\s*(\d+)\r$", raw[: 1 << 16])
            need = len(raw) + 1 if length is None else length.end() + int(length[1]) + (1 << 16)
            if str(e) not in ("content length does not fit", "headers do not end") or start + len(raw) >= window.size or need <= size:
                raise
            size = min(need, 4 * size) if length is None else need


def next_start(window: Buffered, at: int) -> int:
    """The first place from ``at`` on where a gzip member or version line seems to begin; else the end."""
    while at < window.size:
        part = window.get(at, READ_BYTES)
        line = LINE.search(part)
        places = [p for p in (part.find(MAGIC), line.start() if line else -1) if p >= 0]
        if places:
            return at + min(places)
        # what is searched for may lie across the edge
        at += max(1, len(part) - 9) if at + len(part) < window.size else len(part)
    return window.size


def salvage(path: str, start: int, end: int) -> Iterator[dict]:
    """Records that begin in bytes [start, end) of an archive, and the gaps that follow them.

    A range that does not begin the file first searches for a valid record; what lies before it is
    the business of the range with the last valid record before, which logs any gap after it.
    """
    window = Buffered(path)
    at, gap, reason, aligned = start, None, None, start == 0
    while at < window.size:
        try:
            fields, used = record_at(window, at)
        except Damaged as e:
            if gap is None:
                gap, reason = at, str(e)
            at = next_start(window, at + 1)
            if at >= end and not aligned:
                return
            continue
        if gap is not None and aligned:
            yield {"kind": "gap", "start": gap, "end": at, "reason": reason}
        if at >= end:
            return
        gap, aligned = None, True
        yield {"kind": "record", "start": at, "end": at + used} | fields
        at += used
    if gap is not None and aligned:
        yield {"kind": "gap", "start": gap, "end": window.size, "reason": reason}


def read_archives(spark: SparkSession, archives: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Rows of kind ``record`` and ``gap`` of archives (path, bytes), read in ranges by all tasks.

    Archives whose name does not end in .gz are one range each: inside a record that is not packed
    a payload could pass for a record.
    """
    step = F.when(F.col("path").endswith(".gz"), F.lit(range_bytes)).otherwise(F.greatest("bytes", F.lit(1))).cast("long")
    last = F.greatest(F.lit(0), F.col("bytes") - 1).cast("long")
    ranges = archives.select("path", step.alias("step"), F.explode(F.sequence(F.lit(0).cast("long"), last, step)).alias("start"))
    ranges = ranges.select("path", "start", (F.col("start") + F.col("step")).alias("end"))
    names = [f.split()[0] for f in READ.replace("\n", " ").split(",")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, start, end in zip(pdf["path"], pdf["start"].tolist(), pdf["end"].tolist()):
                held, size = [], 0
                for row in salvage(path, start, end):
                    held.append({"path": path} | row)
                    size += len(row.get("payload") or b"") + 500
                    if size > 8 * READ_BYTES:
                        yield frame(held, names)
                        held, size = [], 0
                yield frame(held, names)

    parts = max(1, ranges.count())
    return ranges.repartition(min(parts, 10 * spark.sparkContext.defaultParallelism + parts // 8), "path", "start").mapInPandas(read, READ)


def frame(rows: list[dict], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in names})
    for n in ("start", "end", "page_id", "payload_bytes", "refers_to"):
        out[n] = out[n].astype("Int64")
    return out


def round_trip(pages: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """Writes ``pages`` to archives in the shared folder and reads all their records back.

    Null payloads count as empty.  Of equal payloads of at least ``least`` bytes the smallest id is
    the response, a null id counting as larger than any; rows that repeat that id are responses
    too.  Payloads of any size are kept whole.  An empty table gives no archives and no rows.  Extra
    columns are ignored.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    archives = scratch.keep(write_archives(pages, f"{scratch.root}/archives", id, url, payload, least), "archives")
    return read_archives(spark, archives)


class Incomplete(RuntimeError):
    """Fewer or more records were read than written; the gaps are in the quarantine table named in the message."""


def checked_round_trip(pages: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """As ``round_trip`` without the payloads, after the records read have been counted against those written.

    Raises ``Incomplete`` if they differ.  Gaps are then kept as a table: path, start, end and reason.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    archives = scratch.keep(write_archives(pages, f"{scratch.root}/archives", id, url, payload, least), "archives")
    return checked(spark, archives, scratch)


def checked(spark: SparkSession, archives: DataFrame, scratch: Scratch) -> DataFrame:
    rows = scratch.keep(read_archives(spark, archives).drop("payload"), "read")
    written = archives.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    found, gaps = rows.agg(F.count_if(F.col("kind") == "record"), F.count_if(F.col("kind") == "gap")).first()
    if found != written or gaps:
        path = scratch.path("quarantine")
        rows.where("kind = 'gap'").select("path", "start", "end", "reason").write.parquet(path)
        raise Incomplete(f"{written} records written, {found} read; {gaps} gaps in {path}")
    return rows


def digest(rows: DataFrame, id: str = "page_id") -> DataFrame:
    """Per record: page id, length and digest of the full payload, type, and the page it refers to."""
    return rows.where("kind = 'record'").select(
        F.col("page_id").alias(id), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def damaged_copies(archives: DataFrame, hits: DataFrame, folder: str) -> DataFrame:
    """Copies of archives with the bytes at the given places inverted: (path of the copy, bytes, records, original).

    ``hits`` has path and at.  Archives without a hit are copied as they are.  A copy is made a part at a time.
    """
    places = hits.groupBy("path").agg(F.array_sort(F.collect_list("at")).alias("places"))  # at most one a record of an archive
    rows = archives.select("path", "bytes", "records").join(places, "path", "left")

    def copy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, size, records, at in zip(*(pdf[c].tolist() for c in ("path", "bytes", "records", "places"))):
                source, name = open_store(path)
                target, root = open_store(folder)
                target.create_dir(root, recursive=True)
                new = f"{uuid.uuid4().hex}.warc.gz"
                flips, begin = iter([] if at is None else sorted(at)), 0
                flip = next(flips, None)
                with source.open_input_stream(name, compression=None) as i, target.open_output_stream(f"{root}/{new}", compression=None) as o:
                    while part := bytearray(i.read(READ_BYTES)):
                        while flip is not None and flip < begin + len(part):
                            part[flip - begin] ^= 0xFF
                            flip = next(flips, None)
                        o.write(bytes(part))
                        begin += len(part)
                yield pd.DataFrame({"path": [f"{folder}/{new}"], "bytes": [size], "records": [records], "original": [path]})

    return rows.mapInPandas(copy, WRITTEN + ", original string")


def salvaged(pages: DataFrame, damaged, id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Writes ``pages`` to archives, damages the records of those for which ``damaged`` holds, and salvages the rest.

    One row per page: id, ``outcome`` (recovered; quarantined: its bytes lie in a logged gap; lost: neither), ``reason`` of the gap and
    ``intact``, whether a recovered record has the digest it was written with.  ``damaged`` is a condition over ``page_id``; in the
    middle of such a record one byte is inverted.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "salvage")
    archives = scratch.keep(write_archives(pages, f"{scratch.root}/archives", id, url, payload), "archives")
    written = scratch.keep(read_archives(spark, archives).where("kind = 'record'").select("path", "start", "end", "page_id", "payload_digest"), "written")
    hits = written.where(damaged).select("path", F.floor((F.col("start") + F.col("end")) / 2).cast("long").alias("at"))
    copies = scratch.keep(damaged_copies(archives, hits, f"{scratch.root}/damaged"), "copies")
    found = read_archives(spark, copies).join(copies.select("path", "original"), "path")
    found = scratch.keep(found.select(F.col("original").alias("path"), "kind", "start", "end", "reason", F.col("page_id").alias("found_id"), F.col("payload_digest").alias("found_digest")), "found")
    # the places of a copy are those of its original, so a record is found where it was written, or lies in the last gap before its end
    records = found.where("kind = 'record'").select("path", "start", "found_id", "found_digest")
    both = written.join(records, ["path", "start"], "left")
    gaps = found.where("kind = 'gap'").select("path", F.col("start").alias("at"), F.struct("end", "reason").alias("gap"))
    events = both.select("path", F.col("start").alias("at"), F.struct("page_id", "payload_digest", "end", "found_id", "found_digest").alias("record"), F.lit(None).cast(gaps.schema["gap"].dataType).alias("gap"))
    events = events.unionByName(gaps.withColumn("record", F.lit(None).cast(events.schema["record"].dataType)))
    before = Window.partitionBy("path").orderBy("at", F.col("record").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    events = events.withColumn("gap", F.last("gap", True).over(before)).where("record IS NOT NULL")
    inside = F.coalesce(F.col("record.end") <= F.col("gap.end"), F.lit(False))
    outcome = F.when(F.col("record.found_id").isNotNull() | F.col("record.found_digest").isNotNull(), "recovered").when(inside, "quarantined").otherwise("lost")
    return events.select(
        F.col("record.page_id").alias(id), outcome.alias("outcome"), F.when(outcome == "quarantined", F.col("gap.reason")).alias("reason"),
        F.when(outcome == "recovered", F.col("record.found_digest").eqNullSafe(F.col("record.payload_digest")) & F.col("record.found_id").eqNullSafe(F.col("record.page_id"))).alias("intact"),
    )
