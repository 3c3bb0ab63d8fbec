"""Sinks: snapshots by version, JSON documents, CSV downloads, run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Items of a JSON document at most, since it is one row.
DOCUMENT_ITEMS = 20_000


def next_snapshot(df: DataFrame, path: str, version: int) -> None:
    """Writes a snapshot version; it fails if that version exists, so a version never changes."""
    df.write.mode("errorifexists").parquet(f"{path}/v={version}")


def json_rows(df: DataFrame, path: str) -> None:
    """One JSON object per line, nulls kept, in as many files as there are partitions."""
    df.write.option("ignoreNullFields", False).json(path)


def json_document(df: DataFrame, limit: int) -> DataFrame:
    """One row with a JSON document {count, items}, of at most ``limit`` items (a report, so bounded).

    ``limit`` is checked: what is larger than ``DOCUMENT_ITEMS`` belongs into ``json_rows``.
    """
    if limit > DOCUMENT_ITEMS:
        raise ValueError(f"a document holds at most {DOCUMENT_ITEMS} items; write JSON Lines")
    items = df.limit(limit).agg(F.collect_list(F.struct(*df.columns)).alias("items"))
    return items.select(F.to_json(F.struct(F.size("items").alias("count"), "items"), {"ignoreNullFields": "false"}).alias("document"))


def csv_download(df: DataFrame, path: str) -> None:
    """CSV with header and ISO dates."""
    df.write.option("header", True).option("dateFormat", "yyyy-MM-dd").option("escape", '"').csv(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
