"""Exact dedup by deterministic block naming (DataFrame functions only).

A text without its ASCII white space is cut into blocks of a fixed number of bytes.  The distinct
blocks are sorted within their shuffle partitions and numbered, which gives each block an integer
name.  Adjacent names are then paired, the distinct pairs are sorted and named in turn, and so on
until each document is down to one name.  Equal name on the same level means equal text: a name is
given to content, never to a hash, so there are no collisions.

A block's hash only shortens the way back from the blocks to the documents.  While the blocks are
named they are compared whole, and that shows whether any hash stands for two different blocks.  If
none does, the hash identifies the block in this corpus and the names are joined on it; otherwise
they are joined on the whole block.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, Scratch, keep_decided

#: Bytes in a block.  Most web documents are one to eight blocks.
BLOCK_BYTES = 2048


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACE_CHARS, "")


def _blocks(data: Column, size: int) -> Column:
    """Array of the binary blocks; an empty text has one empty block."""
    last = F.greatest(F.lit(0), F.floor((F.octet_length(data) - 1) / size)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(data, i * size + 1, F.lit(size)))


def _name(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys, sorted within their partitions and numbered: the column ``name``."""
    return rows.select(*keys).distinct().sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def identities(
    docs: DataFrame, scratch: Scratch, text: str = "text", block_bytes: int = BLOCK_BYTES, block_hash=F.xxhash64
) -> DataFrame:
    """One row per row of ``docs``: its columns but the text, the row's number ``rid``, ``n_points``
    (code points of the original text), ``text_sha256`` and the identity (``level``, ``name``).
    """
    rid = F.monotonically_increasing_id()
    data = docs.withColumn("norm", normalised(F.col(text)))
    raw = F.col("norm").cast("binary")
    cut = data.select(F.explode(_blocks(raw, block_bytes)).alias("block"))
    names = scratch.keep(_name(cut, ["block"]).select(block_hash("block").alias("h"), "name"), "names")
    clash = names.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() > 0
    if clash:
        scratch.drop(names)
        names = scratch.keep(_name(cut, ["block"]).withColumn("h", block_hash("block")), "names")

    blocks = _blocks(raw, block_bytes)
    shown = F.transform(blocks, lambda b: F.struct(block_hash(b).alias("h"), b.alias("block"))) if clash else F.transform(
        blocks, lambda b: F.struct(block_hash(b).alias("h"))
    )
    rows = scratch.keep(
        data.select(
            *[c for c in docs.columns if c != text],
            rid.alias("rid"),
            F.char_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_points"),
            F.sha2(raw, 256).alias("text_sha256"),
            shown.alias("blocks"),
        ),
        "rows",
    )
    on = ["h", "block"] if clash else ["h"]
    named = rows.select("rid", F.posexplode("blocks").alias("pos", "b")).select(
        "rid", "pos", *[F.col(f"b.{k}").alias(k) for k in on]
    ).join(names.select(*on, "name"), on).select("rid", "pos", "name")
    single = F.size("blocks") == 1
    most = rows.agg(F.max(F.size("blocks"))).first()[0] or 1
    level_rows = scratch.keep(named.join(rows.where(~single).select("rid"), "rid", "left_semi"), "level") if most > 1 else None
    done = [
        rows.where(single).select("rid", F.col("blocks")[0].alias("b"))
        .select("rid", *[F.col(f"b.{k}").alias(k) for k in on])
        .join(names.select(*on, "name"), on).select("rid", F.lit(0).alias("level"), "name")
    ]
    for level in range(1, math.ceil(math.log2(most)) + 1 if most > 1 else 1):
        pairs = level_rows.groupBy("rid", F.shiftright("pos", 1).alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
        )
        pairs = scratch.keep(pairs, "pairs")
        scratch.drop(level_rows)
        pair_names = scratch.keep(_name(pairs, ["left", "right"]), "names")
        named = pairs.join(pair_names, ["left", "right"]).select("rid", "pos", "name")
        level_rows = scratch.keep(named, "level")
        scratch.drop(pairs, pair_names)
        ended = level_rows.groupBy("rid").agg(F.max("pos").alias("p"), F.min("name").alias("name"))
        done.append(ended.where("p = 0").select("rid", F.lit(level).alias("level"), "name"))
        # a document that is down to one name is done; the others go on
        if level < math.ceil(math.log2(most)):
            going = level_rows.join(ended.where("p > 0").select("rid"), "rid", "left_semi")
            level_rows = scratch.keep(going, "level")
    found = done[0]
    for d in done[1:]:
        found = found.unionByName(d)
    found = scratch.keep(found, "found")
    return scratch.keep(rows.drop("blocks").join(found, "rid"), "identities")


def exact_dedup(
    docs: DataFrame, id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, block_hash=F.xxhash64
) -> DataFrame:
    """One row per row of ``docs``: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical after deleting ASCII white space.  The row with the most code
    points stays, then the smallest id.  Null text counts as empty; empty texts equal one another.
    A null id is larger than any other.  Of repeated rows (same id and text) exactly one is kept.
    An empty table gives an empty result.  Extra columns are ignored, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    slim = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    rows = identities(slim, scratch, "text", block_bytes, block_hash)
    best = rows.groupBy("level", "name").agg(
        F.min(F.struct((-F.col("n_points")).alias("p"), F.col("id").isNull().alias("z"), "id", "rid")).alias("best"),
        F.count(F.lit(1)).alias("group_size"),
    )
    best = scratch.keep(best, "best")  # so that both sides of the join are plain exchanges, which Spark can split
    return rows.join(best, ["level", "name"]).select(
        F.col("id").alias(id),
        F.col("best.id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("best.rid")).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(docs: DataFrame, id: str = "doc_id", text: str = "text", **kwargs) -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns."""
    key = F.sha2(normalised(F.col(text)).cast("binary"), 256)
    return keep_decided(docs, exact_dedup(docs, id, text, **kwargs), id, key, "text_sha256", text)
