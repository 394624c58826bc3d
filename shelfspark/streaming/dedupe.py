"""Duplicate removal on an unbounded listing feed.

An addition to the batch rules: it keeps the first arrival of each key while
the key stays within the watermark.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfspark.session import work_path

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def dedupe_stream(listings: DataFrame, key: Sequence[str], event_time: str,
                  watermark: str) -> DataFrame:
    """Streaming table without repeats of ``key`` inside the watermark."""
    return listings.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark(list(key))


def dedupe_interval(listings: DataFrame, key: Sequence[str], event_time: str, interval: str,
                    lateness: str) -> DataFrame:
    """The first arrival of each key in each ``interval`` of event time, with that interval.

    A key that comes again in a later interval counts anew. Rows of an interval that ended more than
    ``lateness`` before the latest row of the batches before the last are too late and are dropped. Once an interval is past that
    point its keys leave the state, so the state holds the keys of the open intervals, however long
    the feed runs. Rows without an event time or with a null in the key: the former are dropped, null
    is a key like any other.
    """
    # from here on the interval alone is event time, as a stream has one such column
    plain = F.timestamp_micros(F.unix_micros(event_time))
    return (listings.withWatermark(event_time, lateness)
            .withColumn("interval", F.window(event_time, interval)).withColumn(event_time, plain)
            .where(F.col("interval").isNotNull())
            .dropDuplicates([*key, "interval"]))


def read_feed(spark: SparkSession, folder: str, pattern: str, schema: StructType,
              files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream, older files first."""
    feed = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        feed = feed.option("maxFilesPerTrigger", files_per_batch)
    return feed.parquet(folder)


def run_to_table(stream: DataFrame, name: str, progress: list | None = None) -> DataFrame:
    """Process everything available into a table in the shared folder and read it.

    The state lies in RocksDB, outside the heap, with its changes in the shared folder. ``progress``
    receives one entry a batch.
    """
    spark = stream.sparkSession
    out = work_path(spark, name)
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKS_DB)
    try:
        query = (
            stream.writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", f"{out}/state").option("path", f"{out}/rows")
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)
    if progress is not None:
        progress.extend(query.recentProgress)
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")
