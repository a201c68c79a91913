"""Stand-in tables that Spark derives from the given ones, and the same as SQL for the oracle.

Each SELECT runs unchanged in both engines; tables are named in braces.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from quire.operators import segment
from quire.sources.tables import texts

NOW = "2024-02-01 00:00:00"

VIEWS = {
    "seeded": """SELECT doc_id, lang, source,
  CASE doc_id % 8
    WHEN 0 THEN concat('&nbsp;&lt;b&gt;', text, '&amp;lt;')
    WHEN 1 THEN concat(text, chr(10), '本文由某某书屋提供下载', chr(10), 'QQ群:123456 快来')
    WHEN 2 THEN concat('天才一秒记住本站', chr(10), text, chr(10), 'https://a.example.com/x?y=1 end')
    WHEN 3 THEN concat('他说:你好,世界!(3.14)', chr(10), text)
    WHEN 4 THEN concat('锟斤拷锟斤拷', text, '烫烫烫', chr(7))
    WHEN 5 THEN concat(text, chr(13), chr(10), chr(10), chr(10), chr(10), '尾  段  ')
    WHEN 6 THEN concat('第三章 ', text, '。◇ 四 ◇', text)
    ELSE concat('臺灣國語，她高興及了，因该以经', chr(10), text) END AS text
FROM {documents}""",
    "plain": "SELECT doc_id, text FROM {documents}",
    "files": """SELECT d.doc_id AS id, md5(d.text) AS md5, d.source AS author, concat(d.source, '-', CAST(d.doc_id AS STRING), '.txt') AS file_name, d.n_chars AS file_size,
  CAST(d.doc_id % 97 AS BIGINT) AS created_at,
  CASE WHEN l.doc_id IS NULL THEN 'pending' WHEN l.quality = 1 THEN 'completed' WHEN l.toxic = 1 THEN 'failed' ELSE 'processing' END AS status,
  CASE WHEN l.doc_id IS NULL THEN '' ELSE 'cleaning' END AS current_step
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    "versions": """SELECT o_orderkey AS id, o_custkey AS original_id, o_orderkey AS version_id, o_orderdate AS created_at,
  CASE o_orderstatus WHEN 'O' THEN 'intermediate' WHEN 'F' THEN 'final' ELSE 'original' END AS version_type FROM {orders}""",
    "logs": "SELECT event_id AS id, user_id AS file_id, event_type AS action, props AS details, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status, ts FROM {events}",
    "checks": "SELECT user_id AS service, event_id, ts, event_type <> 'error' AS healthy, CAST(floor(value) AS BIGINT) AS duration_ms FROM {events}",
    "cache": """SELECT l_orderkey AS file_id, l_linenumber AS chunk_id, CASE l_returnflag WHEN 'A' THEN 'cache' WHEN 'N' THEN 'local' ELSE 'remote' END AS source,
  CAST(l_quantity AS INT) * 100 AS processing_time_ms, l_shipdate AS created_at FROM {lineitem}""",
    "retries": """SELECT l_orderkey AS file_id, l_linenumber AS chunk_id, l_partkey % 8 AS retry_count, CASE l_linestatus WHEN 'O' THEN 'pending' ELSE 'failed' END AS status,
  l_shipdate AS updated_at, l_shipdate AS next_retry_at FROM {lineitem} WHERE l_suppkey % 3 = 0""",
    "totals": "SELECT o_orderkey AS file_id, CAST(o_custkey % 9 AS BIGINT) AS total FROM {orders}",
    "usage": "SELECT p_brand AS prompt_name, p_type AS prompt_version, l_returnflag <> 'R' AS success FROM {lineitem} JOIN {part} ON l_partkey = p_partkey",
    "vectors": "SELECT label AS file_id, vec_id AS idx, embedding AS vec FROM {embeddings}",
    "requests": "SELECT user_id AS key, event_id, ts FROM {events}",
}

#: A suggestion for every review row: an added mark, other letters, moved or reversed parts, longer words, a moved end mark, nothing.
REPAIR = "(doc_id + CAST(idx / 2 AS INT)) % 8"
SUGGESTED = f"""CASE {REPAIR} WHEN 0 THEN concat(text, '*') WHEN 1 THEN replace(text, 'e', 'é') WHEN 2 THEN concat(substr(text, 41), substr(text, 1, 40)) WHEN 3 THEN replace(text, 'the', 'THE!')
 WHEN 4 THEN concat('。', text) WHEN 5 THEN substr(text, 31) WHEN 6 THEN concat(reverse(substr(text, 1, 60)), substr(text, 61)) ELSE CASE WHEN doc_id % 3 = 0 THEN '' ELSE replace(text, ' ', '') END END"""
ORIGINAL = f"CASE {REPAIR} WHEN 4 THEN concat(text, '。') ELSE text END"

#: Lines of documents and the review rows made from them; Spark's side is in `lines` and `review`.
ORACLE_VIEWS = {
    "lines": "SELECT doc_id, CAST(unnest(range(len(l))) AS INT) AS idx, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)",
    "review": """SELECT doc_id, idx, text AS original_text, concat(text, '*') AS suggested_text, concat('[', text, ']') AS edited_text,
  CASE (doc_id + idx) % 3 WHEN 0 THEN 'duplicate_paragraph' ELSE 'llm_repair' END AS kind,
  CASE (doc_id + idx) % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' WHEN 2 THEN 'edited' ELSE 'pending' END AS status
FROM lines WHERE idx % 2 = 0""",
    "repairs": f"SELECT doc_id, idx, {ORIGINAL} AS original, {SUGGESTED} AS suggested FROM lines WHERE idx % 2 = 0",
    "paragraphs": r"""SELECT doc_id, CAST(unnest(range(len(l))) AS INT) AS idx, unnest(l) AS text FROM (
  SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '{TRIM}', '', 'g')), lambda x: x <> '') AS l FROM seeded)""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    tables = {t: texts(spark, sf_dir, t) if t == "documents" else spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", sql))}
    return spark.sql(sql, **tables)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.baseline_lines(view(spark, sf_dir, "plain"))


def review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).filter("idx % 2 = 0").selectExpr(
        "doc_id", "idx", "text AS original_text", "concat(text, '*') AS suggested_text", "concat('[', text, ']') AS edited_text",
        "CASE (doc_id + idx) % 3 WHEN 0 THEN 'duplicate_paragraph' ELSE 'llm_repair' END AS kind",
        "CASE (doc_id + idx) % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' WHEN 2 THEN 'edited' ELSE 'pending' END AS status",
    )


def repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).filter("idx % 2 = 0").selectExpr("doc_id", "idx", f"{ORIGINAL} AS original", f"{SUGGESTED} AS suggested")


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.paragraphs(view(spark, sf_dir, "seeded"))


def oracle(sql: str) -> str:
    """SQL with the views it names put before it."""
    from quire.functions.text import TRIM

    every = {k: re.sub(r"\{(\w+)\}", r"\1", v) for k, v in VIEWS.items()} | {k: v.replace("{TRIM}", TRIM) for k, v in ORACLE_VIEWS.items()}
    needed: list[str] = []

    def need(text: str) -> None:
        for name in every:
            if re.search(rf"\b{name}\b", text) and name not in needed and every[name] is not text:
                need(every[name])
                if name not in needed:
                    needed.append(name)

    need(sql)
    return ("WITH " + ",\n".join(f"{n} AS ({every[n]})" for n in needed) + "\n" if needed else "") + sql


def recursive(source: str, sql: str) -> str:
    """SQL with recursive parts over one of the stand-in tables."""
    probe = f"SELECT 1 FROM {source}"
    return oracle(probe).removesuffix(probe).rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + ",\n" + sql
