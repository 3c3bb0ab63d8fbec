"""Shared helpers: scratch tables in the shared folder, source columns, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import components
from ..operators.shared import Scratch, delete, hadoop_path, shared_folder

__all__ = ["Scratch", "components", "delete", "hadoop_path", "shared_folder"]

#: Body of a regular-expression class with the six ASCII white-space characters.
SPACE_CLASS = r"\x20\x09-\x0D"
#: The same characters as a string, for trim and translate.
SPACE_CHARS = " \t\n\x0b\x0c\r"


#: Bytes of an Arrow batch for functions over whole texts.
BATCH_BYTES = "4m"


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes: ten thousand whole texts at once, the default, can be any size.

    A setting of the session that stays: results are computed after the operators return.  A smaller
    bound that is set already is kept.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def release_memory() -> None:
    """Gives freed memory of a Python worker back: workers wait for the next task beside the executor."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or with underscores added until no column of df has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def joined_components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list: (node, root), root the smallest node of its component.

    Nodes without an edge to another node, and roots, are not returned as nodes.
    """
    return components(edges.select(F.col(a).alias("a"), F.col(b).alias("b")), scratch)


#: Decisions on at most so many rows are broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 500_000


def keep_decided(docs: DataFrame, decided: DataFrame, id: str, key: Column, key_name: str, text: str) -> DataFrame:
    """The rows of ``docs`` whose decision is ``kept``, with all their columns.

    ``decided`` has one row per row of ``docs``: id, ``key_name`` (the value of ``key`` there) and
    ``kept``.  Where an id is repeated with one key, the copy with the most code points stays.
    Only decisions are moved: if few rows go, their ids are broadcast and the texts stay in place.
    """
    scratch = Scratch(docs.sparkSession, "keep")
    kid, kkey, many = (free_name(docs, c) for c in ("kept_id", "kept_key", "kept_copies"))
    decided = scratch.keep(
        decided.groupBy(id, key_name)
        .agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("copies"))
        .select(F.col(id).alias(kid), F.col(key_name).alias(kkey), "kept", F.col("copies").alias(many)),
        "decided",
    )
    gone, repeated = decided.agg(F.count_if(~F.col("kept")), F.count_if(F.col("kept") & (F.col(many) > 1))).first()
    same = F.col(id).eqNullSafe(F.col(kid)) & (key == F.col(kkey))
    if not repeated and gone <= BROADCAST_ROWS:
        return docs.join(F.broadcast(decided.where(~F.col("kept")).select(kid, kkey)), same, "left_anti")
    joined = docs.join(decided.where("kept").select(kid, kkey, many), same)
    alone = joined.where(F.col(many) == 1).select(*docs.columns)
    if not repeated:
        return alone
    longest = F.max_by(F.struct(*docs.columns), F.char_length(F.coalesce(F.col(text), F.lit("")))).alias("row")
    return alone.unionByName(joined.where(F.col(many) > 1).groupBy(kid, kkey).agg(longest).select("row.*"))
