"""Profiles of a stream, a row for each column of each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators.profile import profile, sketches, united


def profile_stream(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append the profile of each micro-batch, with its number, to a Parquet table.

    Each batch has a folder of its own that a retry overwrites, so a batch is never counted twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        profile(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/run={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def sketch_stream(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keep the sketches of each micro-batch, a few KB a column, in a folder of its own that a retry overwrites."""

    def write(batch: DataFrame, number: int) -> None:
        sketches(batch).write.mode("overwrite").parquet(f"{path}/run={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def profile_so_far(spark: SparkSession, path: str) -> DataFrame:
    """The profile of all micro-batches that sketch_stream has kept, without reading their rows again."""
    return united(spark.read.parquet(path))
