"""Sources: CSV items, JSON Lines with a count of broken lines, JSON documents, XML items, snapshots, HTML pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Schema of the item table's columns that every source fills.
ITEM_SCHEMA = """source_type string, source_name string, title string, organization string, posted_at date, due_at date,
 amount long, region string, keywords string, summary string, url string, relevance_score double"""


def csv_items(spark: SparkSession, path: str, schema: str | StructType = ITEM_SCHEMA, is_sample: bool = True) -> DataFrame:
    """Items of CSV files with a header; missing texts are empty; marked as sample rows."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(schema).csv(path)
    return df.na.fill("").withColumn("is_sample", F.lit(is_sample))


def json_lines(spark: SparkSession, path: str | Sequence[str], schema: str, required: Sequence[str] = ()) -> DataFrame:
    """Rows of JSON Lines files, packed or not, with ``malformed``: no JSON, or a required field is blank.

    Adds ``file`` and keeps the broken line in ``corrupt``, so that counts need no second read.
    """
    if not isinstance(schema, str):
        raise TypeError("schema must be a DDL string")
    df = spark.read.schema(f"{schema}, corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt").json(path)
    bad = F.col("corrupt").isNotNull()
    for c in required:
        bad = bad | (F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "")
    return df.withColumn("malformed", bad).withColumn("file", F.col("_metadata.file_path"))


def json_items(spark: SparkSession, path: str, item_schema: str) -> DataFrame:
    """Items of JSON documents that are an array of items or an object with an ``items`` array."""
    text = spark.read.text(path, wholetext=True).select(F.ltrim("value").alias("t"))
    wrapped = F.when(F.startswith("t", F.lit("[")), F.concat(F.lit('{"items":'), F.col("t"), F.lit("}"))).otherwise(F.col("t"))
    items = F.from_json(wrapped, f"struct<items: array<struct<{item_schema}>>>")["items"]
    return text.select(F.explode(items).alias("item")).select("item.*")


def xml_items(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """Rows of XML files, one per element with the tag."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def html_pages(spark: SparkSession, path: str) -> DataFrame:
    """Saved pages: (file, html)."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("html"))


def by_manifest(manifest: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows of the enabled samples; a sample without rows stays as one row with ``missing`` set."""
    enabled = manifest.where(F.coalesce("enabled", F.lit(True)))
    found = rows.withColumn("_there", F.lit(True))
    return enabled.join(found, key, "left").withColumn("missing", F.col("_there").isNull()).drop("_there")


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """All versions of a snapshot directory with sub-folders v=<number>."""
    return spark.read.parquet(path)


def largest_version(versions: DataFrame, version: str = "v") -> DataFrame:
    """(version, rows) of the version with most rows, the newest of equals: one row."""
    counted = versions.groupBy(version).agg(F.count(F.lit(1)).alias("rows"))
    return counted.agg(F.max(F.struct("rows", version)).alias("m")).where("m is not null").select(F.col(f"m.{version}").alias(version), "m.rows")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))
