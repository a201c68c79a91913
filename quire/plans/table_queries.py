"""Queries over the bookkeeping tables, health checks and streams, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.text import TRIM as T
from quire.operators import catalog, clean, health, review
from quire.plans.text_queries import DIGEST, digest
from quire.plans.views import NOW, oracle, recursive, view
from quire.plans.views import review as review_rows
from quire.sources import corpus
from quire.sources.shared import shared_folder
from quire.streaming import ingest, jobs, ordered

#: Moments that lie within the tables' times, and sizes of quotas.
SHIP_NOW = "1996-06-01 00:00:00"
LIMIT, SECONDS = 3, 86_400


def on(name: str, job):
    """A query that applies a job to one stand-in table."""
    return lambda spark, sf_dir: job(view(spark, sf_dir, name))


def q_ingest_resolve(spark, sf_dir):
    files = view(spark, sf_dir, "files").select("id", "md5", "status", "current_step").groupBy("md5").agg(F.min("id").alias("id"), F.min("status").alias("status"), F.min("current_step").alias("current_step"))
    docs = view(spark, sf_dir, "plain")
    versions = docs.filter("doc_id % 3 = 0").groupBy(F.md5(F.concat("text", F.lit("v")).cast("binary")).alias("version_md5")).agg(F.min("doc_id").alias("original_md5")).withColumn("step", F.lit("indexing"))
    incoming = docs.select(F.explode(F.array(F.md5("text"), F.md5(F.concat("text", F.lit("v"))), F.md5(F.concat("text", F.lit("w"))))).alias("md5")).distinct()
    return catalog.resolve_ingest(incoming, files, versions)


SQL_INGEST = oracle(
    """SELECT i.md5, CASE WHEN status = 'completed' THEN 'completed' WHEN status = 'failed' THEN 'failed' WHEN status IS NOT NULL THEN 'in_progress' WHEN step IS NOT NULL THEN 'intermediate' ELSE 'new' END AS class,
 CASE WHEN status IS NULL THEN original_md5 END AS original_md5, CASE WHEN status IS NULL THEN step WHEN status <> 'completed' THEN current_step END AS resume_step
FROM (SELECT DISTINCT unnest([md5(text), md5(text || 'v'), md5(text || 'w')]) AS md5 FROM documents) i
LEFT JOIN (SELECT md5, min(status) AS status, min(current_step) AS current_step FROM files GROUP BY 1) f ON i.md5 = f.md5
LEFT JOIN (SELECT md5(text || 'v') AS md5, min(doc_id) AS original_md5, 'indexing' AS step FROM documents WHERE doc_id % 3 = 0 GROUP BY 1) v ON i.md5 = v.md5"""
)


def q_cascade_delete(spark, sf_dir):
    gone = view(spark, sf_dir, "files").filter("status = 'failed'").select(F.col("id").alias("file_id"))
    parts = {"logs": view(spark, sf_dir, "logs"), "cache": view(spark, sf_dir, "cache"), "retries": view(spark, sf_dir, "retries"), "versions": view(spark, sf_dir, "versions").withColumnRenamed("original_id", "file_id"), "files": view(spark, sf_dir, "files").withColumnRenamed("id", "file_id")}
    counts = [catalog.without_files(rows, gone).agg(F.count(F.lit(1)).alias("kept")).select(F.lit(name).alias("name"), "kept") for name, rows in parts.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


SQL_CASCADE = oracle(
    " UNION ALL ".join(
        f"SELECT '{name}' AS name, count(*) AS kept FROM {name} WHERE {key} NOT IN (SELECT id FROM files WHERE status = 'failed')" for name, key in (("logs", "file_id"), ("cache", "file_id"), ("retries", "file_id"), ("versions", "original_id"), ("files", "id"))
    )
)


def q_cache_lookup(spark, sf_dir):
    docs = view(spark, sf_dir, "plain").select(F.col("doc_id").alias("file_id"), "text")
    cache = docs.filter("file_id % 4 = 0").select("file_id", F.md5(F.col("text").cast("binary")).alias("chunk_hash"), F.concat(F.lit("fixed:"), F.col("file_id").cast("string")).alias("repaired_text"))
    return catalog.cache_lookup(docs, cache).select("file_id", "chunk_hash", "repaired_text")


SQL_CACHE_LOOKUP = "SELECT doc_id AS file_id, md5(text) AS chunk_hash, CASE WHEN doc_id % 4 = 0 THEN 'fixed:' || doc_id END AS repaired_text FROM documents"


def q_unfinished(spark, sf_dir):
    return catalog.unfinished_chunks(view(spark, sf_dir, "totals"), view(spark, sf_dir, "cache"))


SQL_UNFINISHED = oracle(
    "SELECT file_id, CAST(chunk_id AS INT) AS chunk_id FROM (SELECT file_id, unnest(range(total)) AS chunk_id FROM totals WHERE total > 0) t WHERE NOT EXISTS (SELECT 1 FROM cache c WHERE c.file_id = t.file_id AND c.chunk_id = t.chunk_id)"
)


def q_progress(spark, sf_dir):
    return catalog.progress_info(view(spark, sf_dir, "cache"), view(spark, sf_dir, "totals"))


SQL_PROGRESS = oracle(
    """SELECT file_id, total, processed, remaining, cache_hits, api_calls, avg_ms,
 CAST(CASE WHEN remaining > 0 AND avg_ms > 0 THEN floor(floor(remaining * (CASE WHEN seen > 0 THEN api_calls / seen ELSE 1.0 END) * avg_ms) / 1000) ELSE 0 END AS BIGINT) AS seconds_left,
 CAST(CASE WHEN total > 0 THEN least(100, floor(processed / total * 100)) ELSE 0 END AS BIGINT) AS percent
FROM (SELECT *, greatest(0, total - processed) AS remaining, CAST(CASE WHEN api_calls > 0 THEN floor(ms / api_calls) ELSE 0 END AS BIGINT) AS avg_ms FROM (
 SELECT t.file_id, total, coalesce(seen, 0) AS seen, CASE WHEN total > 0 THEN least(coalesce(seen, 0), total) ELSE coalesce(seen, 0) END AS processed, coalesce(cache_hits, 0) AS cache_hits, coalesce(api_calls, 0) AS api_calls, coalesce(ms, 0) AS ms
 FROM totals t LEFT JOIN (SELECT file_id, count(*) AS seen, count(*) FILTER (WHERE source = 'cache') AS cache_hits, count(*) FILTER (WHERE source = 'remote') AS api_calls, sum(processing_time_ms) AS ms FROM cache GROUP BY 1) e ON t.file_id = e.file_id))"""
)


def q_prompt_usage(spark, sf_dir):
    usage = view(spark, sf_dir, "usage")
    return catalog.prompt_usage(usage, catalog.prompt_usage(usage.filter("success")).drop("success_rate")).withColumn("success_rate", F.round("success_rate", 9))


USAGE = "SELECT prompt_name, prompt_version, count(*) AS uses, count(*) FILTER (WHERE success) AS successes FROM usage GROUP BY ALL"
SQL_PROMPT_USAGE = oracle("SELECT prompt_name, prompt_version, uses + successes AS uses, successes * 2 AS successes, round(successes * 2 / (uses + successes), 9) AS success_rate FROM (" + USAGE + ")")


def q_best_prompt(spark, sf_dir):
    return catalog.best_prompt(catalog.prompt_usage(view(spark, sf_dir, "usage"))).select("prompt_name", "prompt_version", "uses", "successes")


SQL_BEST_PROMPT = oracle(f"SELECT prompt_name, prompt_version, uses, successes FROM (SELECT *, row_number() OVER (PARTITION BY prompt_name ORDER BY successes / uses DESC, uses DESC, prompt_version) AS k FROM ({USAGE})) WHERE k = 1")


def q_upsert(spark, sf_dir):
    old = view(spark, sf_dir, "versions").select("original_id", "version_type", "id")
    key = ["original_id", "version_type"]
    last = old.groupBy(*key).agg(F.max("id").alias("id"))
    return catalog.upsert(last, last.filter("original_id % 2 = 0").withColumn("id", -F.col("id")), key)


SQL_UPSERT = oracle("SELECT original_id, version_type, CASE WHEN original_id % 2 = 0 THEN -max(id) ELSE max(id) END AS id FROM versions GROUP BY original_id, version_type")


def q_metrics(spark, sf_dir):
    return health.service_metrics(view(spark, sf_dir, "checks")).withColumn("success_rate", F.round("success_rate", 6)).withColumn("avg_ms", F.round("avg_ms", 6))


SQL_METRICS = oracle(
    """SELECT service, count(*) AS total_checks, count(*) FILTER (WHERE healthy) AS success_count, round(count(*) FILTER (WHERE healthy) * 100.0 / count(*), 6)::DOUBLE AS success_rate,
 arg_max(event_id, (ts, event_id)) AS last_check, arg_max(event_id, (ts, event_id)) FILTER (WHERE NOT healthy) AS last_error, round(avg(duration_ms) FILTER (WHERE healthy), 6) AS avg_ms FROM checks GROUP BY service"""
)
SQL_HEALTH_RUNS = oracle(
    """SELECT service, event_id, flipped, CAST(sum(CASE WHEN healthy THEN 0 ELSE 1 END) OVER (PARTITION BY service, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS errors FROM (
 SELECT *, coalesce(lag(healthy) OVER w, true) <> healthy AS flipped, sum(CAST(healthy AS INT)) OVER (PARTITION BY service ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM checks WINDOW w AS (PARTITION BY service ORDER BY ts, event_id))"""
)


def q_decide(spark, sf_dir):
    files = view(spark, sf_dir, "files").filter("status = 'completed'").select(F.col("id").alias("doc_id"))
    return review.decide_all(review_rows(spark, sf_dir), files, "approved", NOW).select("doc_id", "idx", "status", "resolved_at")


SQL_DECIDE = oracle(
    f"SELECT doc_id, idx, CASE WHEN hit AND status = 'pending' THEN 'approved' ELSE status END AS status, CASE WHEN hit AND status = 'pending' THEN TIMESTAMP '{NOW}' END AS resolved_at FROM (SELECT *, doc_id IN (SELECT id FROM files WHERE status = 'completed') AS hit FROM review)"
)


def q_reprocess(spark, sf_dir):
    files = view(spark, sf_dir, "files").select("id", "status")
    return catalog.reprocess(files, files.filter("id % 2 = 0"))


SQL_REPROCESS = oracle("SELECT id, CASE WHEN id % 2 = 0 THEN 'pending' ELSE status END AS status, id % 2 = 0 AND status = 'completed' AS drop_review FROM files")


def q_report(spark, sf_dir):
    files = view(spark, sf_dir, "files").select("id", "status")
    rows = review_rows(spark, sf_dir).withColumnRenamed("doc_id", "file_id")
    made = corpus.report(files, rows, view(spark, sf_dir, "logs"), view(spark, sf_dir, "versions"))
    n = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("long")
    return made.select("file_id", "status", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("resolved", F.lit(0)).alias("resolved"), n("logs").alias("n_logs"), n("versions").alias("n_versions"), F.element_at("versions", -1)["version_id"].alias("newest"))


SQL_REPORT = oracle(
    """SELECT f.id AS file_id, f.status, coalesce(total, 0) AS total, coalesce(resolved, 0) AS resolved, coalesce(n_logs, 0) AS n_logs, coalesce(n_versions, 0) AS n_versions, newest FROM files f
 LEFT JOIN (SELECT doc_id, count(*) AS total, count(*) FILTER (WHERE status <> 'pending') AS resolved FROM review GROUP BY 1) r ON f.id = r.doc_id
 LEFT JOIN (SELECT file_id, count(*) AS n_logs FROM logs GROUP BY 1) l ON f.id = l.file_id
 LEFT JOIN (SELECT original_id, count(*) AS n_versions, arg_max(version_id, (created_at, version_id)) AS newest FROM versions GROUP BY 1) v ON f.id = v.original_id"""
)


# ---------------------------------------------------------------- streams


def q_st_ingest(spark, sf_dir):
    """Documents as a stream of file contents, some of them again in GBK: each content is catalogued once, cleaned and cut."""
    docs = jobs.stream_of(spark, sf_dir, "documents")
    contents = F.explode(F.array(F.col("text").cast("binary"), F.concat(F.unhex(F.lit("C4E3BAC30A")), F.col("text").cast("binary")), F.col("text").cast("binary")))
    files = docs.select("doc_id", F.lit(NOW).cast("timestamp").alias("modificationTime"), contents.alias("content")).withColumn("path", F.concat(F.lit("/in/some one-"), F.col("doc_id").cast("string"), F.lit(".txt")))
    base = f"{shared_folder(spark)}/quire-ingest-{uuid.uuid4().hex}"
    ingest.ingest(files, base, lambda d: clean.html_entities(d).drop("n"))
    found = ingest.catalogue(spark, base).join(ingest.stored_paragraphs(spark, base).groupBy("md5").agg(F.count(F.lit(1)).alias("paragraphs"), F.sum(F.char_length("text")).alias("chars")), "md5", "left")
    return found.select("md5", "file_size", F.coalesce("paragraphs", F.lit(0)).alias("paragraphs"), F.coalesce("chars", F.lit(0)).alias("chars"))


_chain = "t"
for _what, _by in clean.ENTITIES.items():
    _chain = f"replace({_chain}, '{_what}', '{_by.replace(chr(39), chr(39) * 2)}')"
#: Each content twice: as it is, and with a line in GBK before it; then its text, cleaned and cut.
SQL_ST_INGEST = rf"""SELECT m AS md5, octet_length(b) AS file_size, CAST(len(l) AS BIGINT) AS paragraphs, CAST(coalesce(list_sum(list_transform(l, lambda x: length(x))), 0) AS BIGINT) AS chars FROM (
 SELECT m, b, list_filter(list_transform(string_split(regexp_replace({_chain}, '\r\n?', chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '{T}', '', 'g')), lambda x: x <> '') AS l FROM (
  SELECT DISTINCT md5(encode(text)) AS m, encode(text) AS b, text AS t FROM documents UNION SELECT DISTINCT md5(unhex('C4E3BAC30A') || encode(text)), unhex('C4E3BAC30A') || encode(text), '你好' || chr(10) || text FROM documents))"""


def q_st_rates(spark, sf_dir):
    events = jobs.stream_of(spark, sf_dir, "events").select("ts", (F.col("event_type") == "error").alias("is_retry"))
    out = jobs.finished(jobs.rates(events), "complete")
    return out.select("window_start", "hits", "retries", F.round("hit_rate", 6).alias("hit_rate"), F.round("error_rate", 6).alias("error_rate"))


SQL_ST_RATES = """SELECT window_start, hits, retries, round(hits * 100.0::DOUBLE / (hits + retries), 6) AS hit_rate, round(retries * 100.0::DOUBLE / (hits + retries), 6) AS error_rate FROM (
 SELECT window_start, count(*) FILTER (WHERE event_type <> 'error') AS hits, count(*) FILTER (WHERE event_type = 'error') AS retries FROM (
  SELECT event_type, date_trunc('hour', ts) - to_hours(CAST(unnest(range(24)) AS INT)) AS window_start FROM events) GROUP BY 1)"""


def q_st_health(spark, sf_dir):
    checks = jobs.stream_of(spark, sf_dir, "events").selectExpr("user_id AS service", "event_id", "ts", "event_type <> 'error' AS healthy", "CAST(floor(value) AS BIGINT) AS duration_ms")
    return jobs.finished(ordered.health(checks))


def q_st_quota(spark, sf_dir):
    requests = jobs.stream_of(spark, sf_dir, "events").selectExpr("user_id AS key", "event_id", "ts")
    return jobs.finished(ordered.quota(requests, LIMIT, SECONDS))


def q_st_cleaning(spark, sf_dir):
    docs = jobs.stream_of(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("&nbsp;他说:"), "text").alias("text"))
    return digest(jobs.finished(jobs.cleaning(docs, lambda d: clean.whitespace_pre(clean.html_entities(d).drop("n")))))


ENTITY_CHAIN = "concat('&nbsp;他说:', text)"
for _what, _by in clean.ENTITIES.items():
    ENTITY_CHAIN = "replace({}, '{}', '{}')".format(ENTITY_CHAIN, _what, _by.replace("'", "''"))
SQL_ST_CLEANING = f"SELECT {DIGEST} FROM (SELECT doc_id, regexp_replace(regexp_replace(replace(replace(regexp_replace({ENTITY_CHAIN}, '[ \\t\\f\\r]+', ' ', 'g'), ' ' || chr(10), chr(10)), chr(10) || ' ', chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), '{T}', '', 'g') AS text FROM documents)"


def rate(job, column: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return job(view(spark, sf_dir, "cache"), view(spark, sf_dir, "retries"), SHIP_NOW).withColumn(column, F.round(column, 9))

    return query


SQL_QUOTA = recursive(
    "requests",
    f"""r AS MATERIALIZED (SELECT key, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS k FROM requests),
s AS (SELECT key, event_id, k, us + {SECONDS * 1_000_000} AS e, 1 AS c, true AS allowed FROM r WHERE k = 1
 UNION ALL SELECT r.key, r.event_id, r.k, CASE WHEN r.us > s.e THEN r.us + {SECONDS * 1_000_000} ELSE s.e END, CASE WHEN r.us > s.e THEN 1 WHEN s.c >= {LIMIT} THEN s.c ELSE s.c + 1 END, r.us > s.e OR s.c < {LIMIT}
 FROM s JOIN r ON r.key = s.key AND r.k = s.k + 1)
SELECT key, event_id, allowed FROM s""",
)
SQL_HEALTH = recursive(
    "checks",
    f"""r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY service ORDER BY ts, event_id) AS k FROM checks),
s AS (SELECT DISTINCT service, CAST(NULL AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS avg_ms, CAST(0 AS BIGINT) AS errors, true AS healthy, false AS flipped, true AS enabled FROM r
 UNION ALL SELECT r.service, r.event_id, r.k, CASE WHEN NOT r.healthy THEN avg_ms WHEN avg_ms = 0 THEN r.duration_ms ELSE (avg_ms * 9 + r.duration_ms) // 10 END, CASE WHEN r.healthy THEN 0 ELSE errors + 1 END,
  r.healthy, r.healthy <> s.healthy, s.enabled AND NOT (r.healthy <> s.healthy AND CASE WHEN r.healthy THEN 0 ELSE errors + 1 END >= {health.ERROR_LIMIT})
 FROM s JOIN r ON r.service = s.service AND r.k = s.k + 1)
SELECT service, event_id, avg_ms, errors, flipped, enabled FROM s WHERE k > 0""",
)

DAY = f"created_at >= TIMESTAMP '{SHIP_NOW}' - INTERVAL 1 DAY"
COUNTS = f"(SELECT (SELECT count(*) FROM cache WHERE {DAY}) AS h, (SELECT count(*) FROM retries WHERE {DAY.replace('created_at', 'updated_at')}) AS r)"

QUERIES = {
    "snk_report": (q_report, SQL_REPORT),
    "flt_pending_files": (on("files", lambda f: f.filter("status <> 'completed'").select("id", "status", "created_at")), oracle("SELECT id, status, created_at FROM files WHERE status <> 'completed'")),
    "flt_retention": (
        lambda s, d: catalog.retained(view(s, d, "cache"), SHIP_NOW, 30).select("file_id", "chunk_id", F.lit("cache").alias("kind")).unionByName(catalog.retained(view(s, d, "retries"), SHIP_NOW, 30, "updated_at", ["completed", "failed"]).select("file_id", "chunk_id", F.lit("retry").alias("kind"))),
        oracle(f"SELECT file_id, chunk_id, 'cache' AS kind FROM cache WHERE created_at >= TIMESTAMP '{SHIP_NOW}' - INTERVAL 30 DAY UNION ALL SELECT file_id, chunk_id, 'retry' FROM retries WHERE NOT (status IN ('completed', 'failed') AND updated_at < TIMESTAMP '{SHIP_NOW}' - INTERVAL 30 DAY)"),
    ),
    "gen_unfinished_chunks": (q_unfinished, SQL_UNFINISHED),
    "join_ingest_resolve": (q_ingest_resolve, SQL_INGEST),
    "join_cascade_delete": (q_cascade_delete, SQL_CASCADE),
    "join_cache_lookup": (q_cache_lookup, SQL_CACHE_LOOKUP),
    "agg_review_progress": (
        lambda s, d: review.review_progress(review_rows(s, d)),
        oracle("SELECT doc_id, count(*) AS total, count(*) FILTER (WHERE status <> 'pending') AS resolved, CAST(floor(count(*) FILTER (WHERE status <> 'pending') * 100 / count(*)) AS BIGINT) AS percent, count(*) = count(*) FILTER (WHERE status <> 'pending') AS complete FROM review GROUP BY doc_id"),
    ),
    "agg_progress_info": (q_progress, SQL_PROGRESS),
    "agg_cache_hit_rate": (rate(catalog.cache_hit_rate, "hit_rate"), oracle(f"SELECT round(CASE WHEN h + r > 0 THEN h * 100.0::DOUBLE / (h + r) ELSE 0 END, 9) AS hit_rate FROM {COUNTS}")),
    "agg_error_rate": (rate(catalog.error_rate, "error_rate"), oracle(f"SELECT round(CASE WHEN h + r > 0 THEN r * 100.0::DOUBLE / (h + r) ELSE 0 END, 9) AS error_rate FROM {COUNTS}")),
    "agg_prompt_usage": (q_prompt_usage, SQL_PROMPT_USAGE),
    "agg_metrics_service": (q_metrics, SQL_METRICS),
    "win_version_parent": (
        on("versions", lambda v: catalog.version_parents(v).select("id", "original_id", "parent_id")),
        oracle("SELECT id, original_id, coalesce(lag(version_id) OVER (PARTITION BY original_id ORDER BY created_at, id), original_id) AS parent_id FROM versions"),
    ),
    "win_latest_version": (
        on("versions", lambda v: catalog.latest(v, ["original_id"], ["created_at", "id"]).select("original_id", "id", "version_type")),
        oracle("SELECT original_id, id, version_type FROM (SELECT *, row_number() OVER (PARTITION BY original_id ORDER BY created_at DESC, id DESC) AS k FROM versions) WHERE k = 1"),
    ),
    "win_latest_log": (on("logs", lambda v: catalog.latest(v, ["file_id"], ["id"]).select("file_id", "id", "action")), oracle("SELECT file_id, max(id) AS id, arg_max(action, id) AS action FROM logs GROUP BY file_id")),
    "win_recent_logs": (
        on("logs", lambda v: catalog.latest(v, ["file_id"], ["ts", "id"], 50).select("file_id", "id", F.col("rank").cast("long").alias("rank"))),
        oracle("SELECT file_id, id, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY ts DESC, id DESC) AS k FROM logs) WHERE k <= 50"),
    ),
    "win_upsert_latest": (q_upsert, SQL_UPSERT),
    "win_best_prompt": (q_best_prompt, SQL_BEST_PROMPT),
    "win_health_runs": (on("checks", lambda c: health.health_runs(c).select("service", "event_id", "flipped", "errors")), SQL_HEALTH_RUNS),
    "win_health_ema": (on("checks", health.health_ema), SQL_HEALTH),
    "top_list_files": (on("files", lambda f: catalog.page(f, 50, 100).select("id", "created_at")), oracle("SELECT id, created_at FROM files ORDER BY created_at DESC, id LIMIT 50 OFFSET 100")),
    "top_due_retries": (
        on("retries", lambda r: catalog.due_retries(r, SHIP_NOW, 100).select("file_id", "chunk_id", "next_retry_at").groupBy("file_id", "chunk_id").agg(F.max("next_retry_at").alias("next_retry_at"))),
        oracle(f"SELECT file_id, chunk_id, max(next_retry_at) AS next_retry_at FROM (SELECT * FROM retries WHERE status = 'pending' AND next_retry_at <= TIMESTAMP '{SHIP_NOW}' ORDER BY next_retry_at, file_id, chunk_id LIMIT 100) GROUP BY ALL"),
    ),
    "srt_version_chain": (
        on("versions", lambda v: v.withColumn("place", F.row_number().over(W.partitionBy("original_id").orderBy("created_at", "id")).cast("long")).select("original_id", "place", "id")),
        oracle("SELECT original_id, row_number() OVER (PARTITION BY original_id ORDER BY created_at, id) AS place, id FROM versions"),
    ),
    "srt_review_items": (lambda s, d: review_rows(s, d).filter("status = 'pending'").select("doc_id", "idx", "kind").orderBy("doc_id", "idx"), oracle("SELECT doc_id, idx, kind FROM review WHERE status = 'pending' ORDER BY doc_id, idx")),
    "srt_logs": (on("logs", lambda v: v.select("file_id", "ts", "id", "action").orderBy("file_id", "ts", "id")), oracle("SELECT file_id, ts, id, action FROM logs ORDER BY file_id, ts, id")),
    "set_batch_decide": (q_decide, SQL_DECIDE),
    "set_reprocess": (q_reprocess, SQL_REPROCESS),
    "set_enqueue_retry": (
        on("retries", lambda r: catalog.enqueue(r, SHIP_NOW).select("file_id", "chunk_id", "retry_count", "next_retry_at", "status")),
        oracle(f"SELECT file_id, chunk_id, retry_count, TIMESTAMP '{SHIP_NOW}' + to_minutes(CAST(least(pow(2, retry_count), 60) AS INT)) AS next_retry_at, 'pending' AS status FROM retries"),
    ),
    "st_ingest": (q_st_ingest, SQL_ST_INGEST),
    "st_rates": (q_st_rates, SQL_ST_RATES),
    "st_health": (q_st_health, SQL_HEALTH),
    "st_quota": (q_st_quota, SQL_QUOTA),
    "st_quota_batch": (on("requests", lambda r: health.quota(r, LIMIT, SECONDS)), SQL_QUOTA),
    "st_cleaning": (q_st_cleaning, SQL_ST_CLEANING),
}
