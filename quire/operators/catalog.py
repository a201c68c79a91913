"""Bookkeeping tables: files, versions, logs, cache, retries, prompts. `now` is always a parameter, so results repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def moment(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


# ---------------------------------------------------------------- newest, oldest, first


def latest(rows: DataFrame, keys: list[str], order: list[str], n: int = 1) -> DataFrame:
    """The last n rows of each key by the order columns (ties by all of them), with rank 1 for the newest."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order]))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= n)


def version_parents(versions: DataFrame) -> DataFrame:
    """Adds parent_id: the version before of the same original; the first one's parent is the original."""
    line = W.partitionBy("original_id").orderBy("created_at", "id")
    return versions.withColumn("parent_id", F.coalesce(F.lag("version_id").over(line), F.col("original_id")))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Insert or replace by key: the later batch wins."""
    both = old.withColumn("batch_", F.lit(0)).unionByName(new.withColumn("batch_", F.lit(1)))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("batch_").desc()))
    return both.withColumn("rank_", rank).filter("rank_ = 1").drop("batch_", "rank_")


def best_prompt(prompts: DataFrame) -> DataFrame:
    """Per prompt the version with the best success ratio, then most uses, then the newest, then by name."""
    ratio = F.when(F.col("uses") > 0, F.col("successes") / F.col("uses")).otherwise(F.lit(0.0))
    rank = F.row_number().over(W.partitionBy("prompt_name").orderBy(ratio.desc(), F.col("uses").desc(), F.col("prompt_version")))
    return prompts.withColumn("rank_", rank).filter("rank_ = 1").drop("rank_")


def page(files: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Files newest first (by id where times tie); the limit is 1 to 200, else 50."""
    limit = limit if 1 <= limit <= 200 else 50
    return files.orderBy(F.col("created_at").desc(), "id").offset(max(0, offset)).limit(limit)


# ---------------------------------------------------------------- cache, retries, prompts


def cache_lookup(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """Chunks (file_id, text) with the cached repair of the same file and text, null if there is none."""
    hashed = chunks.withColumn("chunk_hash", F.md5(F.col("text").cast("binary")))
    return hashed.join(cache.select("file_id", "chunk_hash", "repaired_text"), ["file_id", "chunk_hash"], "left")


def unfinished_chunks(totals: DataFrame, cache: DataFrame) -> DataFrame:
    """Chunk ids 0 .. total - 1 of each file that have no cached repair."""
    wanted = totals.filter("total > 0").select("file_id", F.explode(F.sequence(F.lit(0), (F.col("total") - 1).cast("int"))).alias("chunk_id"))
    return wanted.join(cache.select("file_id", "chunk_id"), ["file_id", "chunk_id"], "left_anti")


def retained(rows: DataFrame, now: str, days: int, column: str = "created_at", statuses: list[str] | None = None) -> DataFrame:
    """Without rows older than `days` (of the given statuses only, if any are given)."""
    old = F.col(column) < moment(now) - F.make_dt_interval(F.lit(days))
    return rows.filter(~(old & F.col("status").isin(statuses)) if statuses else ~old)


def due_retries(retries: DataFrame, now: str, n: int) -> DataFrame:
    """Pending retries that are due, soonest first."""
    due = retries.filter((F.col("status") == "pending") & (F.col("next_retry_at") <= moment(now)))
    return due.orderBy("next_retry_at", "file_id", "chunk_id").limit(n)


def enqueue(failed: DataFrame, now: str) -> DataFrame:
    """Failed chunks with their next time: 2 ^ retry_count minutes from now, an hour at most."""
    minutes = F.least(F.pow(F.lit(2.0), F.col("retry_count")), F.lit(60.0)).cast("int")
    return failed.withColumn("next_retry_at", moment(now) + F.make_dt_interval(F.lit(0), F.lit(0), minutes)).withColumn("status", F.lit("pending"))


def day_counts(cache: DataFrame, retries: DataFrame, now: str) -> DataFrame:
    """One row: cache rows and retry rows of the last 24 hours."""
    since = moment(now) - F.make_dt_interval(F.lit(1))
    both = cache.select(F.lit("hit").alias("kind"), F.col("created_at").alias("at")).unionByName(retries.select(F.lit("retry").alias("kind"), F.col("updated_at").alias("at")))
    return both.agg(F.count_if((F.col("kind") == "hit") & (F.col("at") >= since)).alias("hits"), F.count_if((F.col("kind") == "retry") & (F.col("at") >= since)).alias("retries"))


def cache_hit_rate(cache: DataFrame, retries: DataFrame, now: str) -> DataFrame:
    total = F.col("hits") + F.col("retries")
    return day_counts(cache, retries, now).select(F.when(total > 0, F.col("hits") * 100.0 / total).otherwise(F.lit(0.0)).alias("hit_rate"))


def error_rate(cache: DataFrame, retries: DataFrame, now: str) -> DataFrame:
    total = F.col("hits") + F.col("retries")
    return day_counts(cache, retries, now).select(F.when(total > 0, F.col("retries") * 100.0 / total).otherwise(F.lit(0.0)).alias("error_rate"))


def progress_info(events: DataFrame, totals: DataFrame) -> DataFrame:
    """Per file: processed, remaining, cache hits, API calls, average ms, seconds left, percent. events: (file_id, source, processing_time_ms)."""
    seen = events.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("seen"), F.count_if(F.col("source") == "cache").alias("cache_hits"), F.count_if(F.col("source") == "remote").alias("api_calls"), F.sum("processing_time_ms").alias("ms")
    )
    joined = totals.join(seen, "file_id", "left").na.fill(0, ["seen", "cache_hits", "api_calls", "ms"])
    done = F.when(F.col("total") > 0, F.least("seen", "total")).otherwise(F.col("seen"))
    rows = joined.withColumn("processed", done).withColumn("remaining", F.greatest(F.lit(0), F.col("total") - F.col("processed")))
    rows = rows.withColumn("avg_ms", F.when(F.col("api_calls") > 0, F.floor(F.col("ms") / F.col("api_calls"))).otherwise(F.lit(0)).cast("long"))
    miss = F.when(F.col("seen") > 0, F.col("api_calls") / F.col("seen")).otherwise(F.lit(1.0))
    left = F.when((F.col("remaining") > 0) & (F.col("avg_ms") > 0), F.floor(F.floor(F.col("remaining") * miss * F.col("avg_ms")) / 1000)).otherwise(F.lit(0)).cast("long")
    percent = F.when(F.col("total") > 0, F.least(F.lit(100), F.floor(F.col("processed") / F.col("total") * 100))).otherwise(F.lit(0)).cast("long")
    return rows.select("file_id", "total", "processed", "remaining", "cache_hits", "api_calls", "avg_ms", left.alias("seconds_left"), percent.alias("percent"))


def prompt_usage(usage: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """Uses and successes per (prompt_name, prompt_version), added to an older table of the same columns if one is given."""
    new = usage.groupBy("prompt_name", "prompt_version").agg(F.count(F.lit(1)).alias("uses"), F.count_if("success").alias("successes"))
    if old is not None:
        new = new.unionByName(old.select("prompt_name", "prompt_version", "uses", "successes")).groupBy("prompt_name", "prompt_version").agg(F.sum("uses").alias("uses"), F.sum("successes").alias("successes"))
    return new.withColumn("success_rate", F.col("successes") / F.col("uses"))


# ---------------------------------------------------------------- files


def resolve_ingest(incoming: DataFrame, files: DataFrame, versions: DataFrame) -> DataFrame:
    """Incoming (md5) against the catalogue (md5, status, current_step) and versions (version_md5, original_md5, step)."""
    known = files.select("md5", "status", "current_step")
    seen = versions.select(F.col("version_md5").alias("md5"), "original_md5", "step")
    kind = (
        F.when(F.col("status") == "completed", "completed")
        .when(F.col("status") == "failed", "failed")
        .when(F.col("status").isNotNull(), "in_progress")
        .when(F.col("step").isNotNull(), "intermediate")
        .otherwise("new")
    )
    joined = incoming.join(known, "md5", "left").join(seen, "md5", "left").withColumn("class", kind)
    resume = F.when(F.col("class") == "intermediate", F.col("step")).when(F.col("class").isin("failed", "in_progress"), F.col("current_step"))
    return joined.select("md5", "class", F.when(F.col("class") == "intermediate", F.col("original_md5")).alias("original_md5"), resume.alias("resume_step"))


def without_files(rows: DataFrame, gone: DataFrame, key: str = "file_id") -> DataFrame:
    """Child rows of files that are not deleted."""
    return rows.join(gone.select(F.col("file_id").alias(key)).distinct(), key, "left_anti")


def reprocess(files: DataFrame, chosen: DataFrame) -> DataFrame:
    """Chosen files that are completed, failed or processing start again: status pending, no step, progress 0."""
    hit = files.join(chosen.select("id").distinct().withColumn("hit_", F.lit(True)), "id", "left")
    again = F.col("hit_").isNotNull() & F.col("status").isin("completed", "failed", "processing")
    return hit.withColumn("drop_review", again & (F.col("status") == "completed")).withColumn("status", F.when(again, F.lit("pending")).otherwise(F.col("status"))).drop("hit_")
