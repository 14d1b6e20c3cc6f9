"""Streams: new scenes are analysed and answered requests are recorded as they arrive, each batch once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def analyse_stream(spark: SparkSession, pixels: str, schema: str, analyse: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Every file that appears under ``pixels`` holds whole scenes; each micro-batch's results are appended to ``out``.

    Results carry the batch number, so a batch that runs again replaces its own folder and nothing counts twice.
    """

    def one(batch: DataFrame, number: int) -> None:
        analyse(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(pixels)
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def record_history(spark: SparkSession, entries: str, schema: str, out: str, checkpoint: str):
    """Every file of JSON lines that appears under ``entries`` is recorded once under ``out``, with its batch and place in it.

    A batch that runs again, after a failure between its rows and its commit, replaces its own folder and adds nothing.
    """

    def one(batch: DataFrame, number: int) -> None:
        batch.withColumn("place", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).json(entries)
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def history(spark: SparkSession, out: str) -> DataFrame:
    """What is recorded, newest first: by batch, then by place in it."""
    return spark.read.parquet(out).orderBy(F.desc("batch"), F.desc("place"))
