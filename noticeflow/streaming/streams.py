"""Structured Streaming forms of the ingest: watermarks, dedup, windows, keyed upserts and provider states."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.joins import upsert


def file_stream(spark: SparkSession, path: str, schema, time: str, files_per_batch: int = 1) -> DataFrame:
    """Parquet files as a stream; the time column becomes a timestamp with zone, which watermarks need."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return stream.withColumn(time, F.col(time).cast("timestamp"))


def dedup_in_watermark(stream: DataFrame, time: str, keys: Sequence[str], delay: str) -> DataFrame:
    """The first row per key; keys are forgotten when the watermark passes, so the state is bounded."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def tumbling_counts(stream: DataFrame, time: str, key: str, value: str, width: str, delay: str) -> DataFrame:
    """Rows and sum per window and key, late rows within the delay included."""
    return (
        stream.withWatermark(time, delay)
        .groupBy(F.window(time, width).alias("w"), key)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
        .select(F.col("w.start").alias("start"), key, "n", "total")
    )


def session_counts(stream: DataFrame, time: str, key: str, gap: str, delay: str) -> DataFrame:
    """Rows per session of a key."""
    return (
        stream.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")
    )


def upsert_batches(snapshots: str, keys: Sequence[str], compared: Sequence[str], order: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: upserts each batch into the snapshot before and writes the next version.

    Of several rows of a key in a batch the last by ``order``, columns that tell the arrival, counts.  The version is the batch id, so a batch that runs again after a failure overwrites its own
    version and nothing else.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id == 0:
            before = batch.limit(0)
        else:
            before = spark.read.schema(batch.schema).parquet(f"{snapshots}/v={batch_id - 1}")
        upsert(before, batch, keys, compared, order).drop("status").write.mode("overwrite").parquet(f"{snapshots}/v={batch_id}")

    return run


def provider_strikes(stream: DataFrame, key: str, time: str, status: str, limited: int = 429, ok: int = 200, most: int = 2) -> DataFrame:
    """Strikes per provider after each batch: (key, strikes, quarantined); state is one number per key."""

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        strikes = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(time)
        for s in rows[status]:
            strikes = 0 if s == ok else strikes + (s == limited)
        state.update((int(strikes),))
        yield pd.DataFrame({key: [group[0]], "strikes": [int(strikes)], "quarantined": [strikes >= most]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, strikes long, quarantined boolean", "strikes long", "update", GroupStateTimeout.NoTimeout
    )


def run_available(result: DataFrame, name: str, mode: str, checkpoint: str) -> StreamingQuery:
    """Runs what is there into an in-memory table and waits (for reports and tests)."""
    query = result.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def run_to_files(result: DataFrame, folder: str, mode: str) -> DataFrame:
    """Runs what is there, writes the result as Parquet below the folder and reads it.

    Rows are appended by the file sink; of a complete or updated result each batch is a version of its
    own, which a repeated batch overwrites, and the last one is read (complete) or all (update).
    """
    spark = result.sparkSession
    out = result.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        out.format("parquet").option("path", f"{folder}/rows").start().awaitTermination()
        return spark.read.schema(result.schema).parquet(f"{folder}/rows")
    last = [0]

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/v={number}")
        last[0] = number

    out.foreachBatch(write).start().awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{folder}/rows/v={last[0] if mode == 'complete' else '*'}")
