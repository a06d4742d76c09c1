"""A change log as a stream (an extension: the modelled store replays its log once, at open).

Entries may come in any order; per key the greatest sequence wins, so an older one that arrives late changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.read import newest


def stream_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New Parquet files of a log folder."""
    return spark.readStream.schema(schema).parquet(path)


def newest_stream(log: DataFrame) -> DataFrame:
    """Newest entry of each key so far, for update or complete mode; state is one row a key."""
    return newest(log)


def windowed_counts(log: DataFrame, time: str, width: str, lateness: str) -> DataFrame:
    """Puts and deletes by window of event time; entries later than the watermark are dropped by it."""
    rows = log.withWatermark(time, lateness)
    return rows.groupBy(F.window(time, width)).agg(F.sum(F.when(F.col("op") == 1, 1).otherwise(0)).alias("puts"), F.sum(F.when(F.col("op") == 0, 1).otherwise(0)).alias("deletes"))


def apply_stream(log: DataFrame, write: Callable[[DataFrame], object], checkpoint: str) -> StreamingQuery:
    """Hand every micro-batch once to write; a batch number that was seen before the restart isn't handed on again."""
    return log.writeStream.foreachBatch(lambda batch, _: write(batch) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
