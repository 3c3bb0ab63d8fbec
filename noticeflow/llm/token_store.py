"""Token ids in binary shards, with a minimal perfect hash index from document keys to records.

Documents are dealt out in ranges of their keys; a task encodes its range and writes it as one shard:
raw ids, then the keys and places of its records.  The manifest, a table, lists the shards in order.

The index has a file for each bucket of keys (by hash).  A minimal perfect hash sends the ``n`` keys
of a bucket to the slots 0 to n-1: level by level keys are thrown into a bit array, and those alone at
a bit stay there, while the others go on to the next level; a key's slot is the number of bits set
before its own.  A slot holds a 64-bit fingerprint of its key and the runs of records that have the
key (one for every shard that holds it, so repeated keys are found whole).  A lookup takes constant
time: a few bits, a slot, a run, and two places in the shard; a foreign key is refused by the
fingerprint and, as keys are stored with the records, never answered with another one's ids.

Files are written and read in tasks through pyarrow's file systems.  A task writes under a name of its
own attempt, and only names that came back with its rows are ever read.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..sources.stores import open_store
from .common import Scratch, free_name, release_memory, small_batches

#: Bytes of text in a shard and keys in an index bucket, about; parts that a worker remembers, and
#: characters of texts whose parts are held at once.
SHARD_BYTES, BUCKET_KEYS, REMEMBERED, PORTION = 48 << 20, 1 << 16, 500_000, 1 << 19
END = 2
MAGIC, INDEX_MAGIC = b"NFTOKEN1", b"NFINDEX1"
#: Bits of a level for each key that is still there; levels at most (keys of one 128-bit hash would need more).
GAMMA, LEVELS = 2, 64
#: Footer of a shard: magic, records, ids, bytes an id, crc32 of the ids' bytes.
FOOTER = struct.Struct("<8sQQQQ")
SLOT = np.dtype([("mark", "<u8"), ("run", "<u4"), ("runs", "<u4")])
RUN = np.dtype([("shard", "<u4"), ("record", "<u8"), ("count", "<u8")])
#: Body of a regular-expression class of what any rule may take for white space, and more.
WHITE = r"\s\x00-\x20\x7f-\xa0\u1680\u180e\u2000-\u206f\u3000\ufeff"
#: A space that a piece begins with for certain.
CUT = re.compile(rf"\x20(?=[^{WHITE}])")
#: Latin letters, which every Unicode version knows as letters.
LATIN = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f"
#: Parts of a text: a Latin word with its space that ends before a sign, white space or the end, or all up to the next such space.
PART = re.compile(rf"(?s)\x20[{LATIN}0-9]+(?=[!-/:-@\[-`{{-~\n\x20]|\Z)|.[^\x20]*(?:\x20(?![^{WHITE}])[^\x20]*)*")
#: Parts that are one piece for the pre-tokenizer, so that they can go to the model at once.
WORD = re.compile(rf"\x20?[{LATIN}]+")
#: How byte-level vocabularies write bytes: printable ones as themselves, the others as the characters from 256 on.
SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
WRITTEN_BYTES = {b: chr(b) for b in SHOWN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in SHOWN)}
#: Parts that go to the library at once.
AT_ONCE = 4096


class Encoder:
    """Ids of whole texts by a byte-level tokenizer of the tokenizers library.

    Its pre-tokenizer begins a piece at every space before a visible character, and where a word of
    Latin letters and digits ends before a sign or white space; pieces are encoded one by one.  So a text may
    be cut there, and the library encodes each distinct part once while the worker remembers it: parts
    have numbers, and a batch's ids are gathered by them.  Strings of special tokens are ordinary text.
    """

    def __init__(self, path: str, end: int):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        cut = made["pre_tokenizer"] or {}
        if made["normalizer"] or (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex", True)) != ("ByteLevel", False, True):
            raise ValueError("texts can only be cut for byte-level tokenizers without normaliser and prefix space")
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.width = 2 if max(end + 1, self.library.get_vocab_size()) <= 1 << 16 else 4
        self.kind, self.end = f"<u{self.width}", end.to_bytes(self.width, "little")
        self.numbers: dict[str, int] = {}
        self.starts, self.lengths, self.uses, self.pool = *(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, self.kind)

    def forget(self) -> None:
        """Drops the parts that were seen least: those seen once or twice, or more where they are too many."""
        often = 3
        while (kept := self.uses >= often).sum() > REMEMBERED // 2:
            often *= 2
        old = np.flatnonzero(kept)
        starts, lengths = self.starts[old], self.lengths[old]
        upto = np.cumsum(lengths)
        self.pool = self.pool[np.repeat(starts - upto + lengths, lengths) + np.arange(lengths.sum())]
        self.starts, self.lengths, self.uses = upto - lengths, lengths, self.uses[old]
        numbered = np.cumsum(kept) - 1
        self.numbers = {p: int(numbered[n]) for p, n in self.numbers.items() if kept[n]}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text and the end id."""
        out: list[list[bytes]] = [[] for _ in texts]
        owners, counts, parts = [], [], []
        size = 0
        for i, text in enumerate(texts):
            for stretch in stretches(text):
                found = PART.findall(stretch)
                owners.append(i)
                counts.append(len(found))
                parts += found
                size += len(stretch)
                if size >= PORTION:
                    self.gather(owners, counts, parts, out)
                    owners, counts, parts, size = [], [], [], 0
        self.gather(owners, counts, parts, out)
        return [b"".join(x) + self.end for x in out]

    def gather(self, owners: list[int], counts: list[int], parts: list[str], out: list[list[bytes]]) -> None:
        if len(self.numbers) > REMEMBERED:
            self.forget()
        numbers = np.fromiter(map(self.numbers.get, parts, repeat(-1)), np.int64, len(parts))
        new = np.flatnonzero(numbers < 0).tolist()
        if new:
            self.learn(list(dict.fromkeys([parts[i] for i in new])))
            numbers[new] = [self.numbers[parts[i]] for i in new]
        self.uses += np.bincount(numbers, minlength=len(self.uses))
        lengths = self.lengths[numbers]
        upto = np.cumsum(lengths)
        ids = self.pool[np.repeat(self.starts[numbers] - upto + lengths, lengths) + np.arange(upto[-1] if len(upto) else 0)]
        ends = np.concatenate([[0], upto])[np.cumsum([0, *counts])].tolist()
        for owner, a, b in zip(owners, ends, ends[1:]):
            out[owner].append(ids[a:b].tobytes())

    def learn(self, parts: list[str]) -> None:
        known, ids = len(self.numbers), array("H" if self.width == 2 else "I")
        space, tokenize, whole, lengths = WRITTEN_BYTES[32], self.library.model.tokenize, {}, []
        rest = [p for p in parts if not (p[0] == " " and p[1:].isalpha() and p.isascii() or WORD.fullmatch(p))]
        for at in range(0, len(rest), AT_ONCE):
            own = rest[at : at + AT_ONCE]
            whole |= {p: e.ids for p, e in zip(own, self.library.encode_batch_fast(own, add_special_tokens=False))}
        for p in parts:
            if p in whole:
                own = whole[p]
            elif p[0] == " " and p.isascii():
                own = [t.id for t in tokenize(space + p[1:])]
            else:
                own = [t.id for t in tokenize(p.encode().decode("latin-1").translate(WRITTEN_BYTES))]
            lengths.append(len(own))
            ids.extend(own)
        self.numbers.update(zip(parts, range(known, known + len(parts))))
        upto = np.cumsum(lengths)
        self.starts = np.concatenate([self.starts, len(self.pool) + upto - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.uses = np.concatenate([self.uses, np.zeros(len(parts), np.int64)])
        self.pool = np.concatenate([self.pool, np.array(ids, self.kind)])


def stretches(text: str) -> Iterator[str]:
    """The text in parts of bounded length, cut before spaces where pieces begin."""
    at = 0
    while True:
        found = CUT.search(text, at + PORTION) if len(text) - at > PORTION else None
        yield text[at : found.start() if found else len(text)]
        if not found:
            return
        at = found.start()


def footer(records: int, ids: int, width: int, crc: int) -> bytes:
    return FOOTER.pack(MAGIC, records, ids, width, crc)


def key_bytes(key: str | None) -> bytes:
    return b"\xff" if key is None else key.encode()  # no UTF-8 text is \xff


def write_shards(docs: DataFrame, folder: str, tokenizer: str, id: str, text: str, end: int, shard_bytes: int) -> DataFrame:
    """Writes shards in the order of ``id``; a row per document: shard, path, key, record, at, n, width."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text)).cast("long")), F.lit(0))).first()[0]
    shards = max(1, -(-size // shard_bytes))
    # equal ids lie by text; equal rows, which are interchangeable, may lie in several ranges
    slim = docs.select(
        F.col(id).alias("o"), F.col(id).cast("string").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.xxhash64(F.col(text)).alias("same"), F.monotonically_increasing_id().alias("row"),
    )
    by = [F.col("o").asc_nulls_last(), "same", "row"]
    small_batches(docs.sparkSession)
    rows = slim.repartitionByRange(shards, *by).sortWithinPartitions(*by).select(F.spark_partition_id().alias("shard"), "key", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, out, path, shard, keys, lengths, crc = None, None, "", 0, [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                encoder = Encoder(tokenizer, end)
                store, root = open_store(folder)
                store.create_dir(root, recursive=True)
                shard, name = batch.column(0)[0].as_py(), f"ids-{uuid.uuid4().hex}"
                path, out = f"{folder}/{name}", store.open_output_stream(f"{root}/{name}", compression=None)
            ids = encoder.encode(batch.column(2).to_pylist())
            data = b"".join(ids)
            out.write(data)
            crc = zlib.crc32(data, crc)
            keys += map(key_bytes, batch.column(1).to_pylist())
            lengths.append(np.array([len(x) for x in ids], "<u8"))
        if out is None:
            return
        width = encoder.width
        at = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype("<u8") // width
        names = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype("<u8")
        out.write(b"".join(keys) + names.tobytes() + at.tobytes() + footer(len(keys), int(at[-1]), width, crc))
        out.close()
        encoder = None
        release_memory()
        for lo in range(0, len(keys), 10_000):
            part = slice(lo, min(lo + 10_000, len(keys)))
            n = part.stop - lo
            named = [None if k == b"\xff" else k.decode() for k in keys[part]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard] * n, pa.int32()), pa.array([path] * n), pa.array(named, pa.string()), pa.array(np.arange(lo, part.stop)), pa.array(np.diff(at)[part].astype("<i8")), pa.array([width] * n, pa.int32())],
                names=["shard", "path", "key", "record", "n", "width"],
            )

    return rows.mapInArrow(write, "shard int, path string, key string, record long, n long, width int")


def mix(high: np.ndarray, low: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit hash for each level from a key's 128 bits (a multiply-and-shift finaliser)."""
    x = low + high * np.uint64(2 * level + 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(high, low) 64 bits of each key's 128-bit hash; ``high`` is the stored fingerprint."""
    import xxhash

    raw = np.frombuffer(b"".join(xxhash.xxh3_128_digest(k) for k in keys), ">u8").reshape(-1, 2).astype(np.uint64)
    return raw[:, 0], raw[:, 1]


class PerfectHash:
    """A minimal perfect hash over distinct keys: bit arrays by level, and the bits set before every word of 64."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.begins = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        counts = np.bitwise_count(words).astype(np.int64)
        self.before = np.cumsum(counts) - counts

    @classmethod
    def over(cls, high: np.ndarray, low: np.ndarray) -> PerfectHash:
        sizes, arrays = [], []
        for level in range(LEVELS):
            if not len(high):
                break
            bits = -(-GAMMA * len(high) // 64) * 64
            place = mix(high, low, level) % np.uint64(bits)
            hit = np.bincount(place.astype(np.int64), minlength=bits)
            arrays.append(np.packbits(hit == 1, bitorder="little").view("<u8"))
            sizes.append(bits)
            stay = hit[place.astype(np.int64)] > 1
            high, low = high[stay], low[stay]
        if len(high):
            raise ValueError("two keys have one 128-bit hash, or a key is given twice")
        return cls(np.array(sizes, "<u8"), np.concatenate([*arrays, np.zeros(0, "<u8")]))

    def slots(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for some keys that were not among the built ones, any slot for others."""
        out, left = np.full(len(high), -1, np.int64), np.arange(len(high))
        for level, bits in enumerate(self.sizes):
            place = (mix(high[left], low[left], level) % np.uint64(bits)).astype(np.int64) + self.begins[level]
            word, bit = self.words[place >> 6], (place & 63).astype(np.uint64)
            found = (word >> bit) & np.uint64(1) == 1
            below = word & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[found]] = (self.before[place >> 6] + np.bitwise_count(below))[found]
            left = left[~found]
        return out


class Bucket:
    """An index file: perfect hash, slots and runs.  Layout: magic, levels, slots, runs, level sizes, bits, slots, runs."""

    def __init__(self, data: bytes):
        magic, levels, slots, runs = struct.unpack_from("<8sQQQ", data)
        if magic != INDEX_MAGIC:
            raise ValueError("not an index file")
        sizes = np.frombuffer(data, "<u8", levels, 32)
        at = 32 + 8 * levels
        words = np.frombuffer(data, "<u8", int(sizes.sum()) // 64, at)
        self.hash, at = PerfectHash(sizes, words), at + 8 * len(words)
        self.slots = np.frombuffer(data, SLOT, slots, at)
        self.runs = np.frombuffer(data, RUN, runs, at + SLOT.itemsize * slots)

    @staticmethod
    def packed(keys: list[bytes], runs: np.ndarray, first: np.ndarray) -> bytes:
        """``first``: where each key's runs begin; runs of a key stand together."""
        high, low = hashes(keys)
        h = PerfectHash.over(high, low)
        slots = np.zeros(len(keys), SLOT)
        at = h.slots(high, low)
        slots["mark"][at], slots["run"][at], slots["runs"][at] = high, first, np.diff(first, append=len(runs))
        return struct.pack("<8sQQQ", INDEX_MAGIC, len(h.sizes), len(slots), len(runs)) + h.sizes.tobytes() + h.words.tobytes() + slots.tobytes() + runs.tobytes()

    def find(self, keys: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
        """(place in ``keys``, runs) of those whose fingerprint agrees."""
        high, low = hashes(keys)
        at = self.hash.slots(high, low)
        for i in np.flatnonzero((at >= 0) & (self.slots["mark"][at] == high)) if len(self.slots) else ():
            s = self.slots[at[i]]
            yield int(i), self.runs[s["run"] : int(s["run"]) + int(s["runs"])]


def bucket_of(key, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def grouped(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """The rows of each value of a column, which stand together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        values = batch.column(column).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi == lo:
                continue
            if held and held[-1].column(column)[0].as_py() != values[lo]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


class Store:
    """Shards and index of one writing: ``manifest`` (shard, path, docs, ids, start) and ``index`` (bucket, index_path), both tables."""

    def __init__(self, spark: SparkSession, manifest: DataFrame, index: DataFrame, buckets: int):
        self.spark, self.manifest, self.index, self.buckets = spark, manifest, index, buckets

    @classmethod
    def write(cls, docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", end: int = END, shard_bytes: int = SHARD_BYTES, bucket_keys: int = BUCKET_KEYS) -> Store:
        """Encodes ``docs`` and writes shards and index into the shared folder.

        Null texts are empty; an empty text is the end id alone.  Ids may be of any type that Spark
        can sort and write as text, null (last in order) or repeated: every row is a record.  Extra
        columns are ignored.  An empty table gives no files.
        """
        spark = docs.sparkSession
        scratch = Scratch(spark, "tokens")
        records = scratch.keep(write_shards(docs, f"{scratch.root}/shards", tokenizer, id, text, end, shard_bytes), "records")
        shards = records.groupBy("shard", "path").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("ids"))
        before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for a shard
        manifest = scratch.keep(shards.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0).cast("long"))), "manifest")
        runs = records.groupBy("key", "shard").agg(F.min("record").alias("record"), F.count(F.lit(1)).alias("count"))
        buckets = max(1, -(-records.count() // bucket_keys))
        index = scratch.keep(write_index(runs, f"{scratch.root}/index", buckets), "index")
        return cls(spark, manifest, index, buckets)

    def fetch(self, keys: DataFrame, id: str, take: Callable[[bytes, int], tuple], columns: str) -> DataFrame:
        """Records of the distinct keys in column ``id``: id, ``start``, ``n_tokens``, then what ``take`` makes of their ids.

        A row for each record that has the key (none for a key that is not stored).  ``take`` gets a record's
        ids as little-endian bytes and the bytes an id has; it returns the values of ``columns`` (SQL types).
        """
        asked = keys.select(F.col(id).alias("id")).distinct().select("id", F.col("id").cast("string").alias("key"))
        asked = asked.withColumn("bucket", bucket_of(F.col("key"), self.buckets))
        parts = max(1, min(self.buckets, 8 * self.spark.sparkContext.defaultParallelism))
        asked = asked.join(self.index.withColumnRenamed("bucket", "b"), F.col("bucket") == F.col("b")).drop("b")
        asked = asked.repartition(parts, "bucket").sortWithinPartitions("bucket")
        kind = keys.schema[id].dataType.simpleString()
        found = asked.select("index_path", "id", "key").mapInArrow(_look_up, f"id {kind}, key string, shard int, record long, count long")
        found = found.join(self.manifest.select(F.col("shard").alias("s"), "path", "start"), F.col("shard") == F.col("s")).drop("s")
        found = found.repartition("shard").sortWithinPartitions("shard", "record")
        fields = StructType.fromDDL(columns).fields
        names, kinds = [f.name for f in fields], [to_arrow_type(f.dataType) for f in fields]

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in grouped(batches, "path"):
                shard = Shard(part.column("path")[0].as_py())
                start, rows, size = part.column("start")[0].as_py(), [], 0
                for key, name, record, count in zip(*(part.column(c).to_pylist() for c in ("id", "key", "record", "count"))):
                    for r in range(record, record + count):
                        ids = shard.ids(r, key_bytes(name))
                        if ids is not None:
                            at, n = shard.place(r)
                            rows.append((key, start + at, n, *take(ids, shard.width)))
                            size += len(ids)
                    if size > 8 << 20:
                        yield as_batch(rows, part.schema.field("id").type)
                        rows, size = [], 0
                if rows:
                    yield as_batch(rows, part.schema.field("id").type)

        def as_batch(rows: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
            first, *rest = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(first, key_type), *(pa.array(v, k) for v, k in zip(rest, [pa.int64(), pa.int64(), *kinds]))], names=["id", "start", "n_tokens", *names])

        got = found.select("path", "start", "id", "key", "record", "count").mapInArrow(read, f"id {kind}, start long, n_tokens long, {columns}")
        return got.withColumnRenamed("id", id)


def _look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in grouped(batches, "index_path"):
        store, name = open_store(part.column("index_path")[0].as_py())
        with store.open_input_stream(name, compression=None) as f:
            bucket = Bucket(f.read())
        keys = part.column("key").to_pylist()
        found = [(i, *r) for i, runs in bucket.find([key_bytes(k) for k in keys]) for r in runs.tolist()]
        for lo in range(0, len(found), 10_000):
            i, shard, record, count = zip(*found[lo : lo + 10_000])
            ids = part.select(["id", "key"]).take(pa.array(i)).combine_chunks()
            columns = [c.combine_chunks() for c in ids.columns] + [pa.array(shard, pa.int32()), pa.array(record, pa.int64()), pa.array(count, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "key", "shard", "record", "count"])


def write_index(runs: DataFrame, folder: str, buckets: int) -> DataFrame:
    """Builds an index file for each bucket of (key, shard, record, count); a row per file: bucket, index_path."""
    parts = max(1, min(buckets, 8 * runs.sparkSession.sparkContext.defaultParallelism))
    dealt = runs.withColumn("bucket", bucket_of(F.col("key"), buckets)).repartition(parts, "bucket").sortWithinPartitions("bucket", "key", "shard")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in grouped(batches, "bucket"):
            keys = [key_bytes(k) for k in part.column("key").to_pylist()]
            first = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]]
            entries = np.zeros(len(keys), RUN)
            for c in RUN.names:
                entries[c] = part.column(c).to_numpy()
            store, root = open_store(folder)
            store.create_dir(root, recursive=True)
            name = f"index-{uuid.uuid4().hex}"
            with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(Bucket.packed([keys[i] for i in first], entries, np.array(first)))
            yield pa.RecordBatch.from_arrays([pa.array([part.column("bucket")[0].as_py()], pa.int32()), pa.array([f"{folder}/{name}"])], names=["bucket", "index_path"])

    return dealt.select("bucket", "key", "shard", "record", "count").mapInArrow(write, "bucket int, index_path string")


class Shard:
    """Records of a shard file by number; ids are read in stretches, so that records in order cost no read each."""

    STRETCH = 4 << 20

    def __init__(self, path: str):
        store, name = open_store(path)
        self.file = store.open_input_file(name)
        size = self.file.size()
        magic, self.docs, n_ids, self.width, self.crc = FOOTER.unpack(self.part(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no token shard")
        table = 8 * (self.docs + 1)
        self.at = np.frombuffer(self.part(size - FOOTER.size - table, table), "<u8").astype(np.int64)
        self.names = np.frombuffer(self.part(size - FOOTER.size - 2 * table, table), "<u8").astype(np.int64)
        self.keys_at = n_ids * self.width
        self.keys = self.part(self.keys_at, int(self.names[-1]))
        self.held_at, self.held = 0, b""

    def part(self, at: int, length: int) -> bytes:
        self.file.seek(at)
        return self.file.read(length)

    def place(self, record: int) -> tuple[int, int]:
        """(ids before the record in its shard, ids of the record)."""
        return int(self.at[record]), int(self.at[record + 1] - self.at[record])

    def ids(self, record: int, key: bytes) -> bytes | None:
        """The record's ids as they are stored; None if its key is another one."""
        if self.keys[self.names[record] : self.names[record + 1]] != key:
            return None
        at, n = (x * self.width for x in self.place(record))
        if not self.held_at <= at or at + n > self.held_at + len(self.held):
            self.held_at = at
            self.held = self.part(at, min(max(n, self.STRETCH), self.keys_at - at))
        return self.held[at - self.held_at : at - self.held_at + n]


def crc32(ids: bytes, width: int) -> tuple[int]:
    """crc32 of the ids as unsigned 32-bit integers."""
    return (zlib.crc32(np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes()),)


def digest(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", end: int = END) -> DataFrame:
    """Writes ``docs`` and reads every record back by its key: id, ``start``, ``n_tokens``, ``ids_crc32``; see ``Store.write``."""
    store = Store.write(docs, tokenizer, id, text, end)
    name = free_name(docs.select(id), "ids_crc32")
    return store.fetch(docs, id, crc32, f"{name} long")
