"""Deduplication of a stream with state that is bounded in event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def first_within(stream: DataFrame, event_time: str, delay: str, keys: list[str]) -> DataFrame:
    """The rows of a stream without the copies that follow them within `delay`.

    A key is remembered from its first row on until the watermark, the greatest event time
    so far less `delay`, has passed that row's time plus `delay`; the state holds no key
    longer. A copy in this time is dropped; one that comes later is a first row again. Rows
    behind the watermark are dropped as too late. Null keys are a key like others; rows
    without an event time never pass.
    """
    timed = stream.filter(stream[event_time].isNotNull())
    return timed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def dedup_stream(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    schema: T.StructType | str,
    event_time: str,
    delay: str,
    keys: list[str],
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """First rows of the JSONL files that arrive in `source`, appended to `target`.

    Files are taken in the order of their arrival. State and progress lie in `checkpoint`:
    a run that broke off goes on where it stood and adds each row once.
    """
    reader = spark.readStream.schema(schema).option("mode", "FAILFAST")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    first = first_within(reader.json(source), event_time, delay, keys)
    return (
        first.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
