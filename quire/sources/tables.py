"""Tables as Parquet, dealt to all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch. Spark bounds batches by rows only, and its default (10,000) is much where rows are documents.
BATCH_ROWS, DEFAULT_ROWS = "1000", "10000"


def small_batches(spark: SparkSession) -> None:
    """Lets Arrow batches have BATCH_ROWS rows, if the session has Spark's default: what JVM and worker hold of a batch falls tenfold."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == DEFAULT_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores. A scan has a task for each row group at most, so a table of one small file would run on one core;
    one with tasks enough for all cores, as any large table has, stays as it is and moves no row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows take work, in Arrow batches of few rows."""
    small_batches(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
