"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.tables import small_batches, texts

#: A word for the operators that split on white space only (fixed pattern).
SPACE_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return texts(spark, sf_dir, name)


def released(run: Callable[[Iterator], Iterator], forget: Callable[[], None] | None = None) -> Callable[[Iterator], Iterator]:
    """run over a task's batches; at the end its caches are forgotten, and unused memory of Arrow and of the C library goes back to the system.

    Python workers live on for later stages, so what a task leaves behind would add up.
    """

    def task(batches: Iterator) -> Iterator:
        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            if forget:
                forget()
            pa.default_memory_pool().release_unused()
            _trim()

    return task


def _trim() -> None:
    """Gives the C library's free memory back to the system, where it can (glibc)."""
    import ctypes

    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(m)


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only, whatever the locale."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a new temporary one only where the session names none and is local (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="quire-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage is cut, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quire-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Labels that a model is learned for: each has parameters of its own in every task, so more of them are an error.
MOST_LABELS = 10_000


def bounded_sample(rows: DataFrame, key: str, label: str, most: int, seed: int) -> DataFrame:
    """About `most` rows of each label at most: those whose hashed key lies below most / count. Same rows each time; all of them if fewer.

    The counts of the labels, MOST_LABELS at most, are broadcast.
    """
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("count_"))
    found = counts.limit(MOST_LABELS + 1).collect()
    if len(found) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels in {label}")
    counts = rows.sparkSession.createDataFrame(found, counts.schema)
    share = F.least(F.lit(1.0), F.lit(float(most)) / F.col("count_"))
    place = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    return rows.join(F.broadcast(counts), label).filter(place < share).drop("count_")


def text_slices(sizes: list[int], most: int):
    """Slices of neighbouring rows whose sizes sum to `most` at most (a larger row goes alone)."""
    start = held = 0
    for i, n in enumerate(sizes):
        if held + n > most and i > start:
            yield slice(start, i)
            start, held = i, 0
        held += n
    if sizes:
        yield slice(start, len(sizes))


def text_parts(column, most: int, as_bytes: bool = True):
    """(slice, texts) of an Arrow string column, `most` bytes at a time; nulls come as empty bytes, or as None where texts are strings."""
    import pyarrow as pa
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    for part in text_slices(sizes, most):
        mine = column.slice(part.start, part.stop - part.start)
        yield part, [t or b"" for t in mine.cast(pa.binary()).to_pylist()] if as_bytes else mine.to_pylist()


def schema_of(df: DataFrame, extra: str = "") -> str:
    """DDL of df's columns, and more columns."""
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), *([extra] if extra else [])])
