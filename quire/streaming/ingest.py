"""Ingest as a stream: files that arrive are decoded, catalogued once, cleaned and cut into paragraphs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import segment
from quire.operators.clean import basic_clean, preprocess
from quire.sources.corpus import decoded, file_catalog

FILES = "md5 string, file_size long, file_name string, author string, title string"
PARAGRAPHS = "md5 string, idx int, text string"


def cleaned(docs: DataFrame) -> DataFrame:
    return basic_clean(preprocess(docs))


def arriving(spark: SparkSession, path: str) -> DataFrame:
    """The .txt files of a folder as a stream of (path, modificationTime, length, content)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.[tT][xX][tT]").option("recursiveFileLookup", "true").load(path)


def catalogue(spark: SparkSession, base: str, before: int | None = None) -> DataFrame:
    """The stored catalogue rows, of all batches or of those before one."""
    rows = _read(spark, f"{base}/files", f"{FILES}, batch long")
    return (rows if before is None else rows.filter(F.col("batch") < before)).drop("batch")


def stored_paragraphs(spark: SparkSession, base: str) -> DataFrame:
    return _read(spark, f"{base}/paragraphs", f"{PARAGRAPHS}, batch long").drop("batch")


def _read(spark: SparkSession, path: str, shape: str) -> DataFrame:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], shape)
    return spark.read.schema(shape).parquet(path)


def paragraphs_of(files: DataFrame, job: Callable[[DataFrame], DataFrame] = cleaned) -> DataFrame:
    """(md5, content) -> md5, idx, text."""
    docs = files.select(F.col("md5").alias("doc_id"), decoded(F.col("content")).alias("text"))
    return segment.paragraphs(job(docs)).select(F.col("doc_id").alias("md5"), "idx", "text")


def ingest(files: DataFrame, base: str, job: Callable[[DataFrame], DataFrame] = cleaned, delay: str = "1 hour", **options: str) -> None:
    """Takes all files that are there now into the tables below `base` (files, paragraphs), each content once.

    Contents that arrive again within `delay` are dropped by the stream, whose state forgets older ones; what came earlier is dropped by
    an anti-join with the stored catalogue. A batch writes partitions of its own, so one that is tried again replaces its rows.
    """
    marked = files.withColumn("md5", F.md5("content")).withWatermark("modificationTime", delay).dropDuplicatesWithinWatermark(["md5"])

    def save(batch: DataFrame, number: int) -> None:
        known = catalogue(batch.sparkSession, base, number).select("md5")
        new = batch.join(known, "md5", "left_anti").dropDuplicates(["md5"]).persist()
        tables = ("files", file_catalog(new)), ("paragraphs", paragraphs_of(new, job))
        for name, rows in tables:
            rows.write.mode("overwrite").parquet(f"{base}/{name}/batch={number}")
        new.unpersist()

    query = marked.writeStream.outputMode("append").foreachBatch(save).option("checkpointLocation", f"{base}/state").options(**options).trigger(availableNow=True).start()
    query.awaitTermination()
