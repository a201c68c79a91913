"""Streams: rates and cleaning, and how a stream runs to its end. Each has a batch twin that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.clean import basic_clean
from quire.sources.shared import shared_folder


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")  # a pattern, as the table may be a file or a folder


def finished(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now and returns what it wrote; a batch that is tried again replaces its own rows."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/quire-stream-{uuid.uuid4().hex}"

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/rows/{'all' if mode == 'complete' else number}")

    stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{base}/rows")


def rates(events: DataFrame) -> DataFrame:
    """(ts, is_retry) -> per sliding day, hour by hour: hits, retries, hit_rate, error_rate; rows an hour late are dropped."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "1 hour")
    counted = timed.groupBy(F.window("at", "24 hours", "1 hour")).agg(F.count_if(~F.col("is_retry")).alias("hits"), F.count_if("is_retry").alias("retries"))
    total = F.col("hits") + F.col("retries")
    return counted.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "hits", "retries", (F.col("hits") * 100.0 / total).alias("hit_rate"), (F.col("retries") * 100.0 / total).alias("error_rate"))


def cleaning(docs: DataFrame, job: Callable[[DataFrame], DataFrame] = basic_clean) -> DataFrame:
    """Cleaning is stateless, so a stream takes the batch job as it is."""
    return job(docs)
