"""Queries over texts: cleaning, segmentation, duplicates, repairs, and their SQL."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as fn
from quire.operators import changes, clean, dedup, review, segment
from quire.plans.views import lines, oracle, paragraphs, recursive, repairs, view
from quire.plans.views import review as review_rows
from quire.sources import corpus, files
from quire.sources.shared import shared_folder

T = fn.TRIM
MARK = clean.MARKER


def digest(df: DataFrame, *more: str) -> DataFrame:
    """Cleaned texts by MD5 and length, with the counts beside them."""
    return df.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.char_length("text").cast("long").alias("n_chars"), *more)


DIGEST = "doc_id, md5(text) AS text_md5, CAST(length(text) AS BIGINT) AS n_chars"


def cleaned(job, *more):
    return lambda spark, sf_dir: digest(job(view(spark, sf_dir, "seeded").select("doc_id", "text")), *more)


def sql_text(expr: str, *more: str, source: str = "seeded") -> str:
    """SELECT of digests over an expression of the text."""
    extra = "".join(f", {m}" for m in more)
    names = "".join(f", {m.rsplit(' AS ', 1)[1]}" for m in more)
    return oracle(f"SELECT {DIGEST}{names} FROM (SELECT doc_id, {expr} AS text{extra} FROM {source})")


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_chain(expr: str, steps: list[tuple[str, str]], literal: bool = False) -> str:
    for what, by in steps:
        expr = f"replace({expr}, {quote(what)}, {quote(by)})" if literal else f"regexp_replace({expr}, {quote(what)}, {quote(by)}, 'g')"
    return expr


def sql_counted(steps: list[tuple[str, str]], literal: bool = False, source: str = "seeded", name: str = "n") -> str:
    """Replacements in order, counting hits on the running text."""
    columns, hits, now = [], [], "text"
    for i, (what, by) in enumerate(steps):
        hits.append(f"CAST((length({now}) - length(replace({now}, {quote(what)}, ''))) / {len(what)} AS BIGINT)" if literal else f"len(regexp_extract_all({now}, {quote(what)}))")
        columns.append(f"{sql_chain(now, [(what, by)], literal)} AS t{i}, {hits[-1]} AS n{i}")
        now = f"t{i}"
    total = " + ".join(f"n{i}" for i in range(len(steps)))
    return oracle(f"SELECT {DIGEST}, {name} FROM (SELECT doc_id, {now} AS text, CAST({total} AS BIGINT) AS {name} FROM (SELECT doc_id, text, {', '.join(columns)} FROM {source}))")


BASIC_SPACE = sql_chain(sql_chain(sql_chain(sql_chain("text", [(clean.CONTROL, "")]), [("\r\n", "\n"), ("\r", "\n")], True), [("\n{3,}", "\n\n"), ("[ \t]+(\n|\\z)", "\\1"), ("[ \t]{2,}", " ")]), [(T, "")])
PRE_SPACE = sql_chain(sql_chain(sql_chain("text", [("[ \t\f\r]+", " ")]), [(" \n", "\n"), ("\n ", "\n")], True), [("\n{3,}", "\n\n"), (T, "")])
#: The context rule for half-width marks, character by character.
CJK_CHAR = (
    "lambda c, i: CASE WHEN strpos(',.:;?!()[]', c) > 0 AND len(list_filter(list_slice(cs, greatest(i - 3, 1), i + 2), lambda x: regexp_matches(x, '\\p{Han}'))) > 0 "
    "THEN substr('，。：；？！（）【】', strpos(',.:;?!()[]', c), 1) ELSE c END"
)


def sql_garbled() -> str:
    inner, prev = "SELECT doc_id, text AS g0, CAST(0 AS BIGINT) AS r0, CAST(0 AS BIGINT) AS c0 FROM seeded", 0
    for i, p in enumerate(clean.GARBLED, 1):
        m = f"regexp_extract_all(g{prev}, {quote(p)})"
        join = f"array_to_string(list_transform(list_zip(string_split_regex(g{prev}, {quote(p)}), {m}), lambda z: z[1] || coalesce('{MARK[0]}' || length(z[2]) || '{MARK[1]}', '')), '')"
        inner = f"SELECT doc_id, {join} AS g{i}, r{prev} + len({m}) AS r{i}, CAST(c{prev} + coalesce(list_sum(list_transform({m}, lambda x: length(x))), 0) AS BIGINT) AS c{i} FROM ({inner})"
        prev = i
    return oracle(f"SELECT {DIGEST}, n_runs, n_chars_garbled FROM (SELECT doc_id, g{prev} AS text, r{prev} AS n_runs, c{prev} AS n_chars_garbled FROM ({inner}))")


BLACKLIST = ["QQ群[^\n]*", "https?://[^ \n]+", "(?P<head>er)[[:lower:]]+nd", r"\bthe\s", r"\p{Han}{4,}", r"\Q锟斤拷\E", r"(?i)\bÜB\w*"]
#: What RE2 refuses is skipped.
NO_PATTERNS = ["(unclosed", "", r"\h+", r"(?=a)", r"(a)\1", r"\p{IsHan}"]
TYPO_MAP = {"因该": "应该", "以经": "已经", "the": "THE", "de la": "DE-LA"}


def q_ad_blacklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = F.array(*map(F.lit, [*BLACKLIST, *NO_PATTERNS]))
    return digest(clean.ad_blacklist(view(spark, sf_dir, "seeded").withColumn("ad_blacklist", patterns)))


def q_typo_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.create_map(*[F.lit(x) for kv in TYPO_MAP.items() for x in kv])
    return digest(clean.typo_map(view(spark, sf_dir, "seeded").withColumn("typo_map", pairs)))


def sql_typo_map() -> str:
    expr = "text"
    for wrong, right in sorted(TYPO_MAP.items()):
        expr = f"regexp_replace({expr}, '\\b{wrong}\\b', '{right}', 'g')" if any(ord(c) < 128 for c in wrong) else f"replace({expr}, '{wrong}', '{right}')"
    return sql_text(expr)


def default_rules(spark: SparkSession) -> list[tuple[str, str]]:
    """The enabled rules, a short list; `apply_rules` skips those that are no patterns."""
    return [(r["pattern"], r["replacement"]) for r in corpus.rules_table(spark).filter("enabled").orderBy("id").collect()]


#: A user's rules beside the default ones, and the same with DuckDB's templates; the last two are no patterns.
USER_RULES = [("(?P<head>[[:upper:]])(?P<tail>[[:lower:]]+)ion\\b", "${tail}-${head}0$$", "\\2-\\10$"), ("(\\p{Han})[,.:]", "$1·", "\\1·"), ("(bad", "x", None), ("(?<!a)b", "x", None)]


def q_apply_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = default_rules(spark) + [(p, by) for p, by, _ in USER_RULES]
    return digest(clean.apply_rules(view(spark, sf_dir, "seeded"), rules), "changed")


RULE_STEPS = [(r[2], r[3]) for r in corpus.DEFAULT_RULES] + [(p, by) for p, _, by in USER_RULES if by]


def step_columns(docs: DataFrame, rules: list[tuple[str, str]], config: str | None = None, content: str | None = None) -> DataFrame:
    """The cleaning step up to its line ends: pre-clean, basic clean, the file's own advertisements and typos, rules. Also raw_, the text
    as it was, and r_, the file's rules. With `content`, a column of bytes, the text is decoded from it."""
    text = corpus.decoded(F.col(content)) if content else F.col("text")
    own = docs.select("doc_id", text.alias("text"), corpus.file_rules(F.col(config) if config else F.lit("")).alias("r_")).withColumn("raw_", F.col("text"))
    if config:
        # Patterns are translated before the chain: Spark merges all steps between two Python functions into one projection, which writes them
        # out thousands of times.
        own = own.withColumn("ads_", clean.translated(F.when(F.col("r_.enableAdCleaning"), F.col("r_.ad_blacklist"))))
    mended = clean.basic_clean(clean.preprocess(own), simplify=F.col("r_.traditionalToSimple"))
    if config:
        typos = F.coalesce(F.when(F.col("r_.enableAdCleaning"), F.col("r_.typo_map")), F.expr("cast(map() as map<string,string>)"))
        mended = clean.typo_map(clean.without(mended, "ads_").withColumn("typos_", typos), "typos_")
    return clean.apply_rules(mended, rules)


def step_cleaning(docs: DataFrame, rules: list[tuple[str, str]], config: str | None = None, content: str | None = None) -> DataFrame:
    """The cleaning step: decoding, pre-clean, basic clean, the file's own advertisements and typos, rules, paragraphs, titles.

    config is a column with the file's rule JSON. Without enableBasicCleaning the text stays as it is; traditionalToSimple
    and enableAdCleaning (blacklist and typos) act for their parts.
    """
    ready = step_columns(docs, rules, config, content)
    return segment.newlines_fixed(ready, keep=(~F.col("r_.enableBasicCleaning"), F.col("raw_")))


STEP_CONFIG = """CASE doc_id % 7 WHEN 1 THEN '{"traditionalToSimple":false}' WHEN 2 THEN '{"enableBasicCleaning":false}' WHEN 3 THEN '{"adBlacklist":"er[a-z]+nd,(bad","typoMap":"the=THE"}'
 WHEN 4 THEN '{"enableAdCleaning":false,"adBlacklist":"e","typoMap":"a=b"}' ELSE '' END"""


def q_step_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(step_cleaning(step_input(spark, sf_dir), default_rules(spark), "config", "content"))


def step_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files as bytes, every fifth with a line in GBK before its UTF-8 lines."""
    raw = F.col("text").cast("binary")
    return view(spark, sf_dir, "seeded").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.concat(F.unhex(F.lit("C4E3BAC30A")), raw)).otherwise(raw).alias("content"), F.expr(STEP_CONFIG).alias("config"))


def q_step_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = step_columns(step_input(spark, sf_dir), default_rules(spark), "config", "content")
    return digest(ready.withColumn("text", F.when(F.col("r_.enableBasicCleaning"), F.col("text")).otherwise(F.col("raw_"))))


SIMPLE = f"translate({{}}, '{clean.TRADITIONAL}', '{clean.SIMPLIFIED}')"


def q_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of the whole cleaning, with its place."""
    found = changes.change_rows(view(spark, sf_dir, "seeded"))
    return found.select("doc_id", "step", "nth", "stage", "kind", "original", "replacement", "position", "confidence")


def q_ads_changes(steps: list[changes.Step]):
    return lambda spark, sf_dir: changes.change_rows(view(spark, sf_dir, "seeded"), steps).select("doc_id", "step", "nth", "original", "position")


def q_undone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned documents with their changes taken back."""
    return digest(changes.undone(changes.logged(view(spark, sf_dir, "seeded").select("doc_id", "text"))))


#: What DuckDB needs in another form: a pattern without look-around, and what the hit itself is.
TRAILING, CONTEXT = "[ \t]+(?=\n|\\z)", clean.NEAR_HAN


def sql_log(steps: list[changes.Step], source: str = "seeded", more: str = "", text: str = "t") -> str:
    """A CTE for each step's text, and the records of all steps."""
    ctes, rows = [f"c0 AS MATERIALIZED (SELECT doc_id, text AS t FROM {source})"], []
    for k, step in enumerate(steps):
        p = quote("[ \t]+(?:\n|\\z)" if step.pattern == TRAILING else step.pattern)
        head = f"{k + 1} AS step, '{step.stage}' AS stage, '{step.kind}' AS kind"
        if step.pattern == CONTEXT:
            ctes.append(f"p{k} AS MATERIALIZED (SELECT doc_id, cs, list_transform(cs, {CJK_CHAR}) AS ds FROM (SELECT doc_id, string_split(t, '') AS cs FROM c{k}))")
            ctes.append(f"c{k + 1} AS MATERIALIZED (SELECT doc_id, array_to_string(ds, '') AS t FROM p{k})")
            rows.append(f"SELECT doc_id, {head}, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS nth, cs[i] AS original, ds[i] AS replacement, i - 1 AS position FROM (SELECT doc_id, cs, ds, unnest(range(1, len(cs) + 1)) AS i FROM p{k}) WHERE cs[i] <> ds[i]")
            continue
        if step.kind == "garbled":
            by = f"'{MARK[0]}' || length(h) || '{MARK[1]}'"
            new = f"array_to_string(list_transform(list_zip(string_split_regex(t, {p}), regexp_extract_all(t, {p})), lambda z: z[1] || coalesce('{MARK[0]}' || length(z[2]) || '{MARK[1]}', '')), '')"
        elif step.kind == "traditional":
            by, new = SIMPLE.format("h"), SIMPLE.format("t")
        else:
            by, new = quote(step.by), f"regexp_replace(t, {p}, {quote(step.by)}, 'g')"
        if step.pattern == TRAILING:
            new = f"regexp_replace(t, '[ \t]+(\n|\\z)', '\\1', 'g')"
        ctes.append(f"c{k + 1} AS MATERIALIZED (SELECT doc_id, {new} AS t FROM c{k})")
        rows.append(
            f"""SELECT doc_id, {head}, i AS nth, h AS original, {by} AS replacement, position FROM (SELECT doc_id, i, rtrim(hits[i], {"chr(10)" if step.pattern == TRAILING else "''"}) AS h,
 CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS position
FROM (SELECT doc_id, hits, parts, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, {p}) AS hits, string_split_regex(t, {p}) AS parts FROM c{k}) WHERE len(hits) > 0))"""
        )
    body = " UNION ALL ".join(f"SELECT doc_id, step, stage, kind, CAST(nth AS BIGINT) AS nth, original, replacement, position FROM ({r})" for r in rows)
    return f"{', '.join(ctes)}, log AS ({body})"


def with_log(steps: list[changes.Step], select: str) -> str:
    """The log of the seeded texts, and a SELECT over it and c0, c1, ..."""
    views = oracle("SELECT 1 FROM seeded").removesuffix("SELECT 1 FROM seeded").rstrip()
    return f"{views}, {sql_log(steps)} {select}"


SQL_CHANGES = with_log(changes.ALL, "SELECT doc_id, step, nth, stage, kind, original, replacement, position, CAST(CASE kind WHEN 'garbled' THEN 1 ELSE 0 END AS DOUBLE) AS confidence FROM log")

def sql_step_columns() -> str:
    """The texts of the change log's chain, with and without the traditional characters, then the files' own rules and the global ones."""
    views = oracle("SELECT 1 FROM seeded").removesuffix("SELECT 1 FROM seeded").rstrip()
    decoded = "files_ AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '你好' || chr(10) || text ELSE text END AS text FROM seeded)"
    kept = [s for s in changes.ALL if s.kind != "traditional"]
    chain = lambda steps: sql_log(steps, "files_").split(", log AS (")[0]
    full, plain = chain(changes.ALL), re.sub(r"\b([cp]\d+)\b", r"x\1", chain(kept))
    rules = sql_chain("CASE WHEN a.doc_id % 7 = 3 THEN regexp_replace(regexp_replace(a.t, 'er[a-z]+nd', '', 'g'), '\\bthe\\b', 'THE', 'g') WHEN a.doc_id % 7 = 1 THEN b.t ELSE a.t END", [(r[2], r[3]) for r in corpus.DEFAULT_RULES])
    return f"{views}, {decoded}, {full}, {plain} SELECT {DIGEST} FROM (SELECT f.doc_id, CASE WHEN f.doc_id % 7 = 2 THEN f.text ELSE {rules} END AS text FROM files_ f JOIN c{len(changes.ALL)} a ON a.doc_id = f.doc_id JOIN xc{len(kept)} b ON b.doc_id = f.doc_id)"


def q_change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.changes(view(spark, sf_dir, "seeded"))


def q_clean_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q_change_counts(spark, sf_dir).groupBy("stage", "kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"))


def sql_changes() -> str:
    entity = " + ".join(f"(length(text) - length(replace(text, {quote(e)}, ''))) // {len(e)}" for e in clean.ENTITIES)
    ads, now, columns = [], "text", []
    for i, p in enumerate(clean.ADS):
        columns.append(f"len(regexp_extract_all({now}, {quote(p)})) AS n{i}, regexp_replace({now}, {quote(p)}, '', 'g') AS t{i}")
        ads.append(f"n{i}")
        now = f"t{i}"
    runs = " + ".join(f"len(regexp_extract_all(text, {quote(p)}))" for p in clean.GARBLED)
    punct = f"(SELECT doc_id, list_sum(list_transform(list_zip(cs, list_transform(cs, {CJK_CHAR})), lambda z: CAST(z[1] <> z[2] AS BIGINT))) AS n FROM (SELECT doc_id, string_split(text, '') AS cs FROM seeded))"
    lf = "replace(replace(regexp_replace(text, '" + clean.CONTROL + "', '', 'g'), chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    return oracle(
        f"""SELECT doc_id, stage, kind, CAST(n AS BIGINT) AS n FROM (
SELECT doc_id, 'basic' AS stage, 'entities' AS kind, {entity} AS n FROM seeded
UNION ALL SELECT doc_id, 'basic', 'punctuation', n FROM {punct}
UNION ALL SELECT doc_id, 'basic', 'blank_lines', CAST(regexp_matches({lf}, '\\n{{3,}}') AS BIGINT) FROM seeded
UNION ALL SELECT doc_id, 'basic', 'traditional', length(text) - length(translate(text, '{clean.TRADITIONAL}', '')) FROM seeded
UNION ALL SELECT doc_id, 'basic', 'advertisement', {" + ".join(ads)} FROM (SELECT doc_id, text, {", ".join(columns)} FROM seeded)
UNION ALL SELECT doc_id, 'pre', 'garbled', {runs} FROM seeded) WHERE n > 0"""
    )


# ---------------------------------------------------------------- paragraphs


def q_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "seeded").select("doc_id", segment.needs_resegmentation(F.col("text")).alias("needed"))


SQL_GATE = oracle(
    rf"""SELECT doc_id, octet_length(encode(text)) >= 100 AND regexp_matches(text, '[。」』？！]') AND
 (nl = 0 OR length(text) // greatest(nl, 1) > 300 OR len(list_filter(string_split(text, chr(10)), lambda x: length(regexp_replace(x, '{T}', '', 'g')) > 500)) > 0) AS needed
FROM (SELECT doc_id, text, length(text) - length(replace(text, chr(10), '')) AS nl FROM seeded)"""
)
NORM = f"regexp_replace(translate(text, '{fn.MARKS}', ''), '{T}', '', 'g')"


def q_title(spark, sf_dir):
    return paragraphs(spark, sf_dir).select("doc_id", "idx", segment.is_chapter_title(F.col("text")).alias("is_title"))


def q_short(spark, sf_dir):
    p = paragraphs(spark, sf_dir)
    return p.select("doc_id", "idx", (F.char_length(fn.normalize_paragraph(F.col("text"))) < dedup.MIN_LENGTH).alias("dedup_short"), (F.char_length("text") < segment.MIN_PARAGRAPH).alias("merge_short"))


def q_paragraphs(spark, sf_dir):
    return paragraphs(spark, sf_dir)


def q_exact_dup(spark, sf_dir):
    return dedup.exact_duplicates(paragraphs(spark, sf_dir)).select("doc_id", "idx", "is_dup", F.when(F.col("is_dup"), F.col("first_idx")).alias("first_idx"))


EXACT = f"SELECT doc_id, idx, text, length(norm) >= {dedup.MIN_LENGTH} AND row_number() OVER w > 1 AS is_dup, first_value(idx) OVER w AS first_idx FROM (SELECT *, {NORM} AS norm FROM paragraphs) WINDOW w AS (PARTITION BY doc_id, norm ORDER BY idx)"


def plain_dups(spark, sf_dir):
    return dedup.exact_duplicates(segment.paragraphs(view(spark, sf_dir, "plain")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = dedup.duplicate_stats(plain_dups(spark, sf_dir).filter("is_dup"))
    return stats.select("doc_id", "n", "chars", F.size("samples").alias("n_samples"), "truncated", F.md5(F.array_join("samples", "\n").cast("binary")).alias("samples_md5"))


PLAIN_PARAGRAPHS = rf"""(SELECT doc_id, CAST(unnest(range(len(l))) AS INT) AS idx, unnest(l) AS text FROM (
  SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '{T}', '', 'g')), lambda x: x <> '') AS l FROM documents))"""
PLAIN_DUPS = f"(SELECT * FROM (SELECT doc_id, idx, text, row_number() OVER (PARTITION BY doc_id, norm ORDER BY idx) AS k, norm FROM (SELECT *, {NORM} AS norm FROM {PLAIN_PARAGRAPHS})) WHERE k > 1 AND length(norm) >= {dedup.MIN_LENGTH})"
SQL_FLAGSHIP = f"""SELECT doc_id, n, chars, len(samples) AS n_samples, n > 20 OR over AS truncated, md5(array_to_string(samples, chr(10))) AS samples_md5 FROM (
  SELECT doc_id, n, CAST(chars AS BIGINT) AS chars, over, CASE WHEN over THEN list_slice(f, 1, 10) ELSE f END AS samples FROM (
    SELECT *, coalesce(list_sum(list_transform(f, lambda x: length(x))), 0) > 5000 AS over FROM (
      SELECT doc_id, count(*) AS n, sum(length(text)) AS chars, list_slice(list(text ORDER BY idx), 1, 20) AS f FROM {PLAIN_DUPS} GROUP BY doc_id)))"""


def q_dup_to_lines(spark, sf_dir):
    return dedup.duplicates_to_lines(plain_dups(spark, sf_dir), lines(spark, sf_dir)).select("doc_id", "idx", "line")


SQL_DUP_TO_LINES = oracle(
    f"""SELECT p.doc_id, p.idx, l.idx AS line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY idx) AS nth FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, norm ORDER BY idx) AS k FROM (SELECT *, {NORM} AS norm FROM {PLAIN_PARAGRAPHS}))) p
JOIN (SELECT doc_id, idx, t, row_number() OVER (PARTITION BY doc_id, t ORDER BY idx) AS nth FROM (SELECT *, regexp_replace(text, '{T}', '', 'g') AS t FROM lines) WHERE t <> '') l
  ON p.doc_id = l.doc_id AND p.text = l.t AND p.nth = l.nth WHERE p.k > 1 AND length(p.norm) >= {dedup.MIN_LENGTH}"""
)


#: The cosines from which the given vectors, most of them random, and paragraphs of random words are shown as alike.
ALIKE, ALIKE_TEXT = 0.3, 0.9


def q_near_dup(spark, sf_dir):
    return dedup.near_duplicates(view(spark, sf_dir, "vectors"), threshold=ALIKE).withColumn("sim", F.round("sim", 6))


COS = "list_dot_product(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[])) / (sqrt(list_dot_product(CAST({0} AS DOUBLE[]), CAST({0} AS DOUBLE[]))) * sqrt(list_dot_product(CAST({1} AS DOUBLE[]), CAST({1} AS DOUBLE[]))))"
SQL_NEAR_DUP = oracle(
    f"SELECT file_id, i, j, round(sim, 6) AS sim FROM (SELECT a.file_id, a.idx AS i, b.idx AS j, {COS.format('a.vec', 'b.vec')} AS sim FROM vectors a JOIN vectors b ON a.file_id = b.file_id AND b.idx < a.idx AND a.idx - b.idx <= {dedup.WINDOW}) WHERE sim >= {ALIKE}"
)


def q_cosine(spark, sf_dir):
    v = view(spark, sf_dir, "vectors")
    return v.alias("a").join(v.alias("b"), F.col("a.idx") == F.col("b.idx") + 1).select(F.col("a.idx").alias("idx"), F.round(fn.cosine(F.col("a.vec"), F.col("b.vec")), 6).alias("cosine"))


def q_local_vector(spark, sf_dir):
    rows = paragraphs(spark, sf_dir).select("doc_id", "idx", fn.local_vector(F.col("text")).alias("vec"))
    parts = F.transform("vec", lambda v, i: F.round(v, 9) * (i + 1))
    return rows.select("doc_id", "idx", F.round(F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x), 3).alias("weighted"), F.size("vec").cast("long").alias("dims"))


def q_near_paragraphs(spark, sf_dir):
    """Near-duplicate paragraphs of all documents by their local vectors, after the gates."""
    return dedup.near_paragraphs(segment.paragraphs(view(spark, sf_dir, "plain")), threshold=ALIKE_TEXT).withColumn("sim", F.round("sim", 6))


def sql_vectors(source: str) -> str:
    """(doc_id, idx, v) of paragraphs, over all their columns."""
    density = ", ".join(f"CASE WHEN length(text) > 0 THEN (length(text) - length(replace(text, '{m}', ''))) / length(text) ELSE 0.0 END" for m in fn.DENSITY_MARKS)
    digests = f"concat(md5({NORM}), md5(concat('quire:', {NORM})))"
    bytes_ = ", ".join(f"CAST(('0x' || substr(d, {2 * i + 1}, 2)) AS INT) / 256.0" for i in range(fn.DIGEST_BYTES))
    mean = "least(list_sum(list_transform(string_split(text, ''), lambda c: CAST(unicode(c) AS BIGINT))) / (length(text) * 65536.0), 1.0)"
    return f"(SELECT doc_id, idx, CAST([least(length(text) / 500.0, 1.0), {density}, {mean}, {bytes_}] AS DOUBLE[]) AS v FROM (SELECT *, {digests} AS d FROM {source}))"


SQL_LOCAL_VECTOR = oracle(f"SELECT doc_id, idx, round(list_sum(list_transform(v, lambda x, i: round(x, 9) * i)), 3) AS weighted, len(v) AS dims FROM {sql_vectors('paragraphs')}")
SQL_NEAR_PARAGRAPHS = f"""WITH vs AS {sql_vectors(f"(SELECT doc_id, idx, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, norm ORDER BY idx) AS k FROM (SELECT *, {NORM} AS norm FROM {PLAIN_PARAGRAPHS})) WHERE k = 1 AND length(norm) >= {dedup.MIN_LENGTH})")}
SELECT doc_id, idx, max(j) AS near_idx, round(arg_max(sim, j), 6) AS sim FROM (SELECT a.doc_id, a.idx, b.idx AS j, {COS.format("a.v", "b.v")} AS sim
 FROM vs a JOIN vs b ON a.doc_id = b.doc_id AND b.idx < a.idx AND a.idx - b.idx <= {dedup.WINDOW}) WHERE sim >= {ALIKE_TEXT} GROUP BY doc_id, idx"""


# ---------------------------------------------------------------- repairs and reviews


def q_valid_repair(spark, sf_dir):
    return q_valid_repair_rows(spark, sf_dir).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def q_valid_repair_rows(spark, sf_dir):
    """All rows, whatever their script, with suggestions of many kinds."""
    return repairs(spark, sf_dir).select("doc_id", "idx", review.repair_verdict(F.col("original"), F.col("suggested")).alias("verdict"))


#: DuckDB's distance is of bytes: characters beyond ASCII become control bytes, which no text has here.
BYTES = "translate({}, 'ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü。', chr(1) || chr(2) || chr(3) || chr(4) || chr(5) || chr(6) || chr(7) || chr(8) || chr(14) || chr(15) || chr(16) || chr(17) || chr(18) || chr(19) || chr(20) || chr(21) || chr(22) || chr(23) || chr(24) || chr(25) || chr(26) || chr(27))"
DISTANCE = f"levenshtein({BYTES.format('o')}, {BYTES.format('s')})"
SQL_VALID_REPAIR = oracle(
    f"""SELECT doc_id, idx, CASE WHEN a = 0 OR b = 0 THEN 'empty' WHEN regexp_matches(s[1], '{review.ENDS}') AND s[1] = o[-1] AND o[1] <> s[1] THEN 'moved_mark' WHEN least(a, b) < 15 AND a <> b THEN 'short_changed'
 WHEN abs(a - b) > 2 AND abs(a - b) / greatest(a, b) > 0.2 THEN 'length' WHEN CASE WHEN greatest(a, b) <= 500 THEN {DISTANCE} / greatest(a, b) > 0.25 ELSE false END THEN 'distance' ELSE 'ok' END AS verdict
FROM (SELECT *, length(o) AS a, length(s) AS b FROM (SELECT doc_id, idx, original AS o, suggested AS s FROM repairs))"""
)


def q_bad_rewrite(spark, sf_dir):
    out = F.expr("CASE doc_id % 5 WHEN 0 THEN 'Request REJECTED by content policy' WHEN 1 THEN substr(text, 1, CAST(length(text) / 5 AS INT)) ELSE text END")
    finish = F.expr("CASE WHEN doc_id % 7 = 0 THEN 'length' ELSE 'stop' END")
    return view(spark, sf_dir, "plain").select("doc_id", review.bad_rewrite(F.col("text"), out, finish).alias("bad"))


SQL_BAD_REWRITE = f"""SELECT doc_id, doc_id % 7 = 0 OR (length(text) > 100 AND length(o) < floor(length(text) * 3 / 10)) OR (length(o) < 200 AND regexp_matches(lower(o), '{review.REFUSALS}')) AS bad
FROM (SELECT doc_id, text, regexp_replace(CASE doc_id % 5 WHEN 0 THEN 'Request REJECTED by content policy' WHEN 1 THEN substr(text, 1, CAST(length(text) / 5 AS INT)) ELSE text END, '{T}', '', 'g') AS o FROM documents)"""


def q_error_class(spark, sf_dir):
    return view(spark, sf_dir, "logs").select("id", review.retryable(F.concat(F.col("details"), F.col("action"), F.col("id").cast("string"))).alias("retryable"))


def q_apply_review(spark, sf_dir):
    return digest(review.apply_review(lines(spark, sf_dir), review_rows(spark, sf_dir)))


SQL_APPLY_REVIEW = oracle(
    f"""SELECT {DIGEST} FROM (SELECT doc_id, string_agg(t, chr(10) ORDER BY idx) AS text FROM (
SELECT l.doc_id, l.idx, CASE WHEN status = 'approved' THEN regexp_replace(suggested_text, '[\\r\\n]', '', 'g') WHEN status = 'edited' THEN edited_text ELSE l.text END AS t, status, kind
FROM lines l LEFT JOIN review r ON l.doc_id = r.doc_id AND l.idx = r.idx) WHERE NOT coalesce(status = 'approved' AND kind = 'duplicate_paragraph', false) GROUP BY doc_id)"""
)


def q_changed_rows(spark, sf_dir):
    s = review_rows(spark, sf_dir).select("doc_id", "idx", F.when(F.col("idx") % 4 == 0, F.col("original_text")).otherwise(F.col("suggested_text")).alias("suggested_text"))
    return review.changed_rows(lines(spark, sf_dir), s).select("doc_id", "idx", "kind", "status", F.md5(F.col("suggested_text").cast("binary")).alias("suggested_md5"))


SQL_CHANGED_ROWS = oracle(
    """SELECT doc_id, idx, 'llm_repair' AS kind, 'pending' AS status, md5(suggested_text) AS suggested_md5 FROM review WHERE idx % 4 <> 0 AND length(original_text) >= 15"""
)


def q_review_union(spark, sf_dir):
    from quire.operators.catalog import upsert

    r = review_rows(spark, sf_dir).select("doc_id", "idx", "original_text", "kind")
    dups = plain_dups(spark, sf_dir).filter("is_dup").select("doc_id", "idx", F.col("text").alias("original_text"), F.lit("duplicate_paragraph").alias("kind"))
    return upsert(dups, r.filter("kind = 'llm_repair'"), ["doc_id", "idx"]).select("doc_id", "idx", "kind", F.md5(F.col("original_text").cast("binary")).alias("original_md5"))


SQL_REVIEW_UNION = oracle(
    f"""SELECT doc_id, idx, kind, md5(t) AS original_md5 FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, idx ORDER BY b DESC) AS k FROM (
SELECT doc_id, idx, text AS t, 'duplicate_paragraph' AS kind, 0 AS b FROM {PLAIN_DUPS} UNION ALL SELECT doc_id, idx, original_text, kind, 1 FROM review WHERE kind = 'llm_repair')) WHERE k = 1"""
)


def q_apply_suggestions(spark, sf_dir):
    docs = view(spark, sf_dir, "plain")
    made = docs.select(
        "doc_id",
        F.explode(
            F.array(
                F.struct(F.lit("typo_correction").alias("kind"), F.lit("er").alias("original"), F.lit("ER").alias("replacement"), F.lit(5).alias("position")),
                F.struct(F.lit("rule").alias("kind"), F.lit("en").alias("original"), F.lit("<en>").alias("replacement"), F.lit(9).alias("position")),
            )
        ).alias("c"),
    ).select("doc_id", "c.*")
    return digest(review.apply_suggestions(docs, made))


SQL_APPLY_SUGGESTIONS = f"SELECT {DIGEST} FROM (SELECT doc_id, replace(CASE WHEN strpos(text, 'en') > 0 THEN substr(text, 1, strpos(text, 'en') - 1) || '<en>' || substr(text, strpos(text, 'en') + 2) ELSE text END, 'er', 'ER') AS text FROM documents)"


def q_chunks(spark, sf_dir):
    found = segment.chunks(view(spark, sf_dir, "plain"), 1000, 100)
    return found.select("doc_id", "chunk_id", "start", "end", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def q_merge_chunks(spark, sf_dir):
    return digest(segment.merge_chunks(segment.chunks(view(spark, sf_dir, "plain"), 1000, 100)))


def q_resegment(spark, sf_dir):
    """A row for each document, without paragraphs too: their number, length and last place, and the MD5 of the text that they make."""
    out = segment.resegmented(view(spark, sf_dir, "seeded"))
    chars = F.aggregate("texts", F.lit(0).cast("long"), lambda n, t: n + F.char_length(t))
    last = F.when(F.size("texts") > 0, F.size("texts") - 1)
    joined = F.md5(F.array_join("texts", "\n\n").cast("binary"))
    return out.select("doc_id", F.size("texts").cast("long").alias("n"), chars.alias("chars"), last.alias("last"), joined.alias("text_md5"))


def q_merge_short(spark, sf_dir):
    return segment.merge_short(paragraphs(spark, sf_dir)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("chars"))


IS_TITLE = f"regexp_matches(regexp_replace({{}}, '{T}', '', 'g'), '{segment.TITLE}')".replace("[\\s\\S]", "[\\x00-\\x{{10FFFF}}]").replace(T, T.replace("{", "{{").replace("}", "}}"))
#: Paragraph by paragraph: what the last one has grown to, and how many joins there were.
SQL_MERGE_SHORT = recursive(
    "paragraphs",
    f"""p AS MATERIALIZED (SELECT doc_id, text, {IS_TITLE.format("text")} AS title, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS k FROM paragraphs),
s AS (SELECT doc_id, k, text AS t, 0 AS joins FROM p WHERE k = 1
 UNION ALL SELECT doc_id, k, CASE WHEN j THEN t || chr(10) || text ELSE text END, joins + CAST(j AS INT)
 FROM (SELECT p.doc_id, p.k, s.t, p.text, joins, length(s.t) < {segment.MIN_PARAGRAPH} AND NOT {IS_TITLE.format("s.t")} AND NOT title AS j FROM s JOIN p ON p.doc_id = s.doc_id AND p.k = s.k + 1))
SELECT doc_id, count(*) - max(joins) AS n, CAST(sum(length(p.text)) + max(joins) AS BIGINT) AS chars FROM p JOIN s USING (doc_id, k) GROUP BY doc_id""",
)


def q_paragraph_diff(spark, sf_dir):
    r = review_rows(spark, sf_dir).withColumn("suggested_text", F.replace("original_text", F.lit("the"), F.lit("THE!")))
    d = segment.paragraph_diff(r)
    side = lambda kinds: F.array_join(F.transform(F.filter("ops", lambda o: o["type"].isin(*kinds)), lambda o: o["value"]), "")
    kept = F.aggregate(F.filter("ops", lambda o: o["type"] == "equal"), F.lit(0).cast("long"), lambda n, o: n + F.regexp_count(o["value"], F.lit(TOKEN)))
    return d.select("doc_id", "idx", F.md5(side(["equal", "delete"]).cast("binary")).alias("before_md5"), F.md5(side(["equal", "insert"]).cast("binary")).alias("after_md5"), kept.alias("kept"))


#: A token of a diff, as Java and RE2 write it. No token of the new text has `the`, and all others can stay.
TOKEN = "(?s)[\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}\\x{F900}-\\x{FAFF}]|[a-zA-Z]+|[0-9]+|\\s+|."
SQL_PARAGRAPH_DIFF = oracle(
    f"""SELECT doc_id, idx, md5(original_text) AS before_md5, md5(replace(original_text, 'the', 'THE!')) AS after_md5,
 CAST(len(list_filter(regexp_extract_all(original_text, '{TOKEN}'), lambda t: NOT contains(t, 'the'))) AS BIGINT) AS kept FROM review"""
)


def q_join_paragraphs(spark, sf_dir):
    return digest(segment.join_paragraphs(lines(spark, sf_dir)))


def q_levenshtein(spark, sf_dir):
    """All repairs, whole texts of any script."""
    return repairs(spark, sf_dir).select("doc_id", "idx", fn.edit_distance(F.col("original"), F.col("suggested")).cast("long").alias("distance"))


def q_positional(spark, sf_dir):
    return view(spark, sf_dir, "plain").select("doc_id", F.round(fn.positional_similarity(F.col("text"), F.concat(F.substr("text", F.lit(1), F.lit(50)), F.lit("x"), F.substr("text", F.lit(51)))), 6).alias("similarity"))


SQL_POSITIONAL = """SELECT doc_id, round(coalesce(list_sum(list_transform(list_zip(a, b), lambda z: CASE WHEN z[1] = z[2] THEN 1 ELSE 0 END)), 0) / greatest(len(a), len(b)), 6) AS similarity
FROM (SELECT doc_id, string_split(text, '') AS a, string_split(substr(text, 1, 50) || 'x' || substr(text, 51), '') AS b FROM documents)"""


# ---------------------------------------------------------------- sources and sinks


def _stage(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/quire-texts-{uuid.uuid4().hex}"


def q_src_corpus(spark, sf_dir, max_size=corpus.MAX_SIZE):
    """The documents' texts, written as 16 parts of .txt files by Spark, read as raw files.

    Files are bounded, so that none is over the reader's limit: a part's texts are dealt to folders of about `bound` bytes,
    and a folder's running size cuts it into files of at most `bound` bytes and one more row. A longer text goes by lines.
    """
    path, bound = _stage(spark), max_size // 6
    docs = view(spark, sf_dir, "plain").select("doc_id", (F.col("doc_id") % 16).alias("part"), "text")
    rows = F.when(F.octet_length("text") < bound, F.array("text")).otherwise(F.split("text", "\n"))
    sizes = docs.groupBy("part").agg(F.sum(F.octet_length("text") + F.lit(1)).alias("bytes"))
    folders = max(1, -(-(sizes.agg(F.max("bytes")).first()[0] or 0) // bound))
    size = F.octet_length("value") + F.lit(1)
    in_order = W.partitionBy("part", "folder").orderBy("doc_id", "pos").rowsBetween(W.unboundedPreceding, -1)
    dealt = docs.select("doc_id", "part", F.posexplode(rows).alias("pos", "value")).withColumn("folder", F.pmod(F.xxhash64("doc_id", "pos"), F.lit(folders)))
    dealt = dealt.repartition(16 * folders, "part", "folder").withColumn("file", F.floor(F.coalesce(F.sum(size).over(in_order), F.lit(0)) / bound))
    fits = F.when(size <= max_size - bound, F.col("value")).otherwise(F.raise_error(F.lit("a line is over the size of a raw file")))
    dealt.select("part", "folder", "file", fits.alias("value")).write.partitionBy("part", "folder", "file").text(path)
    files = corpus.read_corpus(spark, path, max_size)
    return files.select(F.regexp_extract("path", "part=([0-9]+)", 1).cast("int").alias("part"), "length").groupBy("part").agg(F.sum("length").alias("bytes"))


SQL_SRC_CORPUS = "SELECT CAST(doc_id % 16 AS INT) AS part, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS bytes FROM documents GROUP BY 1"


def q_src_decode(spark, sf_dir):
    """Documents as files of bytes, each with a line in GBK before its UTF-8 lines, read back by ranges of lines and decoded line by line."""
    path = _stage(spark)
    raw = F.concat(F.unhex(F.lit("C4E3BAC30A")), F.col("text").cast("binary"))
    files.write_files(view(spark, sf_dir, "plain").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), raw.alias("content")), path)
    found = corpus.decode_lines(files.read_lines(spark, path, RANGE))
    doc_id = F.regexp_extract("path", r"([0-9]+)\.txt\z", 1).cast("long").alias("doc_id")
    return found.groupBy(doc_id, "encoding").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.char_length("text")).alias("chars"))


#: Bytes of a range of lines.
RANGE = 8 << 20
SQL_SRC_DECODE = "SELECT doc_id, 'utf-8' AS encoding, len(string_split(text, chr(10))) AS lines, CAST(length(replace(text, chr(10), '')) AS BIGINT) AS chars FROM documents UNION ALL SELECT doc_id, 'gbk', 1, 2 FROM documents"


def q_src_file_catalog(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return corpus.file_catalog(d.select(F.concat(F.lit("/in/"), "source", F.lit("-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").cast("binary").alias("content"))).drop("file_name")


SQL_FILE_CATALOG = "SELECT md5(text) AS md5, octet_length(encode(text)) AS file_size, source AS author, CAST(doc_id AS STRING) AS title FROM documents"


def q_src_rules_table(spark, sf_dir):
    """Rules in a file, and how many documents each of them touches."""
    path = _stage(spark)
    spark.createDataFrame([(corpus.rules_json(),)], "value string").coalesce(1).write.text(path)
    rules = corpus.rules_table(spark, path)
    docs = view(spark, sf_dir, "seeded")
    listed = [(r["id"], r["pattern"]) for r in rules.collect()]  # a short list
    touched = docs.agg(*[F.count_if(F.col("text").rlike(p)).alias(f"n{i}") for i, (_, p) in enumerate(listed)])
    each = F.array(*[F.struct(F.lit(k).alias("id"), F.col(f"n{i}").alias("docs")) for i, (k, _) in enumerate(listed)])
    counts = touched.select(F.explode(each).alias("c")).select("c.*")
    return rules.join(counts, "id").select("id", "pattern", "replacement", "enabled", "docs")


SQL_RULES_TABLE = oracle(
    " UNION ALL ".join(f"SELECT '{r[0]}' AS id, {quote(r[2])} AS pattern, '{r[3]}' AS replacement, true AS enabled, count(*) FILTER (WHERE regexp_matches(text, {quote(r[2])})) AS docs FROM seeded" for r in corpus.DEFAULT_RULES)
)


def q_src_file_rules(spark, sf_dir):
    config = F.expr(
        """CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN concat('{"typoMap":"a=b, c=', source, '","similarityThreshold":0}') WHEN 2 THEN concat('{"typoMap":{"x":"', source, '"},"enableAdCleaning":false}')
 WHEN 3 THEN '{"adBlacklist":"q1, q2,,q3","similarityThreshold":0.5}' WHEN 4 THEN '{"adBlacklist":["u","v"]}' ELSE '{bad json' END"""
    )
    rules = view(spark, sf_dir, "seeded").select("doc_id", corpus.file_rules(config).alias("r"))
    return rules.select("doc_id", "r.enableAdCleaning", "r.similarityThreshold", F.size("r.typo_map").alias("n_typos"), F.array_join("r.ad_blacklist", "|").alias("ads"), F.array_join(F.array_sort(F.map_values("r.typo_map")), "|").alias("typo_values"))


SQL_FILE_RULES = """SELECT doc_id, doc_id % 6 <> 2 AS enableAdCleaning, CAST(CASE WHEN doc_id % 6 = 3 THEN 0.5 ELSE 0.95 END AS DOUBLE) AS similarityThreshold, CASE doc_id % 6 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS n_typos,
 CASE doc_id % 6 WHEN 3 THEN 'q1|q2|q3' WHEN 4 THEN 'u|v' ELSE '' END AS ads, CASE doc_id % 6 WHEN 1 THEN 'b|' || source WHEN 2 THEN source ELSE '' END AS typo_values FROM documents"""


#: A file's rules as JSON, in both ways of writing them; some files have none, one kind is broken.
FILE_CONFIG = """CASE id % 5 WHEN 0 THEN concat('{"typoMap":{"the":"', upper(author), '"},"adBlacklist":"er[a-z]+nd"}') WHEN 1 THEN concat('{"typoMap":"the=', upper(author), ', de la=DE-LA"}')
 WHEN 2 THEN '{"adBlacklist":["er[[:lower:]]+nd","(bad"]}' WHEN 3 THEN '{bad' END"""


def q_join_file_rules(spark, sf_dir):
    """Documents with the parsed rules of their files, which then act on them."""
    rules = view(spark, sf_dir, "files").selectExpr("id AS doc_id", f"{FILE_CONFIG} AS config").filter("id % 7 <> 6").select("doc_id", corpus.file_rules(F.col("config")).alias("r"))
    docs = corpus.with_file_rules(view(spark, sf_dir, "plain"), rules)
    return digest(clean.typo_map(clean.ad_blacklist(docs.withColumn("ad_blacklist", F.col("r.ad_blacklist")).withColumn("typo_map", F.col("r.typo_map")))))


SQL_JOIN_FILE_RULES = f"""SELECT {DIGEST} FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 6 THEN text WHEN doc_id % 5 = 0 THEN regexp_replace(regexp_replace(text, 'er[a-z]+nd', '', 'g'), '\\bthe\\b', upper(source), 'g')
 WHEN doc_id % 5 = 1 THEN regexp_replace(regexp_replace(text, '\\bde la\\b', 'DE-LA', 'g'), '\\bthe\\b', upper(source), 'g') WHEN doc_id % 5 = 2 THEN regexp_replace(text, 'er[a-z]+nd', '', 'g') ELSE text END AS text FROM documents)"""


def q_final_text(spark, sf_dir):
    """One file for each document, read back."""
    path = _stage(spark)
    corpus.write_final(view(spark, sf_dir, "plain").select(F.col("doc_id").alias("file_id"), F.col("text").alias("content")), path)
    back = files.read_files(spark, path)
    return digest(back.select(F.regexp_extract("name", "[0-9]+", 0).cast("long").alias("doc_id"), F.col("content").alias("text")))


SQL_FINAL_TEXT = f"SELECT {DIGEST} FROM documents"


def q_step_versions(spark, sf_dir):
    """A step written, written again, and read back with its texts."""
    base = _stage(spark)
    texts = view(spark, sf_dir, "plain").select(F.col("doc_id").alias("file_id"), F.col("text").alias("content"))
    versions = view(spark, sf_dir, "versions")
    corpus.write_step(texts, "cleaning", versions, base)
    corpus.write_step(texts, "cleaning", versions, base)
    kept = corpus.read_step_texts(spark, base).groupBy("file_id", "step", "version_md5").agg(F.count(F.lit(1)).alias("texts"), F.max(F.md5(F.col("content").cast("binary"))).alias("text_md5"))
    rows = corpus.read_versions(spark, base).select("file_id", "step", "version_md5", "parent_id")
    return rows.join(kept, ["file_id", "step", "version_md5"]).select("file_id", "step", "version_md5", "parent_id", "texts", "text_md5")


SQL_STEP_VERSIONS = oracle(
    "SELECT d.doc_id AS file_id, 'cleaning' AS step, md5(text) AS version_md5, coalesce(p, doc_id) AS parent_id, CAST(1 AS BIGINT) AS texts, md5(text) AS text_md5 FROM documents d LEFT JOIN (SELECT original_id, arg_max(version_id, (created_at, id)) AS p FROM versions GROUP BY 1) v ON d.doc_id = v.original_id"
)

TYPO_HITS = " + ".join(f"(length(text) - length(replace(text, {quote(w)}, ''))) // {len(w)}" for w, _ in clean.TYPOS)
SQL_DICT_REPAIR = oracle(
    f"SELECT doc_id, idx, CAST(CASE WHEN length(text) >= 10 THEN {TYPO_HITS} ELSE 0 END AS BIGINT) AS n, md5(CASE WHEN length(text) >= 10 THEN {sql_chain('text', list(clean.TYPOS), True)} ELSE text END) AS text_md5 FROM paragraphs"
)

SQL_POST_CHAPTERS = oracle(
    f"""SELECT {DIGEST}, n_chapters FROM (SELECT doc_id, CAST(len(h) AS BIGINT) AS n_chapters, array_to_string(list_transform(p, lambda x, i:
 CASE WHEN i > 1 AND x <> '' AND x[1] <> chr(10) THEN chr(10) || chr(10) ELSE '' END || x ||
 CASE WHEN i > len(h) THEN '' WHEN (x = '' AND i > 1) OR (x <> '' AND x[-1] <> chr(10)) THEN chr(10) || chr(10) || h[i] ELSE h[i] END), '') AS text
FROM (SELECT doc_id, regexp_extract_all(text, '{clean.CHAPTERS}') AS h, string_split_regex(text, '{clean.CHAPTERS}') AS p FROM seeded))"""
)
#: A full stop is looked at with its neighbours; then runs of each mark collapse.
SQL_POST_PUNCT = oracle(
    f"""SELECT {DIGEST} FROM (SELECT doc_id, {sql_chain("t", [(m + "+", m) for m in "，。：；？！"])} AS text FROM (SELECT doc_id, array_to_string(list_transform(cs, lambda c, i:
 CASE WHEN c = '.' AND NOT regexp_matches(coalesce(cs[i - 1], ''), '[0-9]') AND NOT regexp_matches(coalesce(cs[i + 1], ''), '[0-9]') THEN '。' ELSE c END), '') AS t
FROM (SELECT doc_id, string_split(translate(text, ',:;?!', '，：；？！'), '') AS cs FROM seeded)))"""
)

QUERIES = {
    "src_corpus": (q_src_corpus, SQL_SRC_CORPUS),
    "src_decode_corpus": (q_src_decode, SQL_SRC_DECODE),
    "src_file_catalog": (q_src_file_catalog, SQL_FILE_CATALOG),
    "src_rules_table": (q_src_rules_table, SQL_RULES_TABLE),
    "src_file_rules": (q_src_file_rules, SQL_FILE_RULES),
    "snk_step_versions": (q_step_versions, SQL_STEP_VERSIONS),
    "snk_final_text": (q_final_text, SQL_FINAL_TEXT),
    "cl_html_entities": (cleaned(clean.html_entities, "n"), sql_counted(list(clean.ENTITIES.items()), True)),
    "cl_cjk_punct": (
        cleaned(clean.cjk_punct, "n"),
        oracle(f"SELECT {DIGEST}, n FROM (SELECT doc_id, array_to_string(ds, '') AS text, CAST(list_sum(list_transform(list_zip(cs, ds), lambda z: CAST(z[1] <> z[2] AS BIGINT))) AS BIGINT) AS n FROM (SELECT doc_id, cs, list_transform(cs, {CJK_CHAR}) AS ds FROM (SELECT doc_id, string_split(text, '') AS cs FROM seeded)))"),
    ),
    "cl_control_chars": (cleaned(clean.control_chars), sql_text(sql_chain("text", [(clean.CONTROL, "")]))),
    "cl_whitespace_basic": (cleaned(clean.whitespace_basic), sql_text(BASIC_SPACE)),
    "cl_whitespace_pre": (cleaned(clean.whitespace_pre), sql_text(PRE_SPACE)),
    "cl_trad_to_simp": (cleaned(clean.trad_to_simp, "n"), sql_text(SIMPLE.format("text"), f"CAST(length(text) - length(translate(text, '{clean.TRADITIONAL}', '')) AS BIGINT) AS n")),
    "cl_ads_basic": (cleaned(clean.ads_basic, "n"), sql_counted([(p, "") for p in clean.ADS])),
    "cl_ads_pre": (cleaned(clean.ads_pre, "n"), sql_counted([(p, "") for p in clean.ADS_PRE])),
    "cl_garbled": (lambda s, d: digest(clean.garbled(view(s, d, "seeded")).withColumnRenamed("n_chars", "n_chars_garbled"), "n_runs", "n_chars_garbled"), sql_garbled()),
    "cl_ad_blacklist": (q_ad_blacklist, sql_text(sql_chain("text", [(p, "") for p in BLACKLIST]))),
    "cl_typo_map": (q_typo_map, sql_typo_map()),
    "cl_apply_rules": (q_apply_rules, sql_text(sql_chain("text", RULE_STEPS), f"text <> {sql_chain('text', RULE_STEPS)} AS changed")),
    "cl_dict_repair": (
        lambda s, d: clean.dict_repair(paragraphs(s, d)).select("doc_id", "idx", "n", F.md5(F.col("text").cast("binary")).alias("text_md5")),
        SQL_DICT_REPAIR,
    ),
    "cl_sanitize_paragraph": (lambda s, d: digest(view(s, d, "seeded").withColumn("text", clean.sanitize_paragraph(F.col("text")))), sql_text("regexp_replace(text, '[\\r\\n]', '', 'g')")),
    "cl_post_format": (cleaned(clean.post_format), sql_text(sql_chain("text", [("\n{3,}", "\n\n"), (T, "")]))),
    "cl_post_chapters": (cleaned(clean.post_chapters, "n_chapters"), SQL_POST_CHAPTERS),
    "cl_post_punct": (cleaned(clean.post_punct), SQL_POST_PUNCT),
    "cl_step_cleaning": (q_step_cleaning, None),
    "cl_step_columns": (q_step_columns, sql_step_columns()),
    "cl_changes": (q_changes, SQL_CHANGES),
    "cl_changes_undone": (q_undone, oracle(f"SELECT {DIGEST} FROM seeded")),
    "cl_ads_basic_changes": (q_ads_changes(changes.ADS_BASIC), with_log(changes.ADS_BASIC, "SELECT doc_id, step, nth, original, position FROM log")),
    "cl_ads_pre_changes": (q_ads_changes(changes.ADS_PRE), with_log(changes.ADS_PRE, "SELECT doc_id, step, nth, original, position FROM log")),
    "cl_change_counts": (q_change_counts, sql_changes()),
    "agg_clean_stats": (q_clean_stats, f"SELECT stage, kind, CAST(sum(n) AS BIGINT) AS n, count(*) AS docs FROM ({sql_changes()}) GROUP BY stage, kind"),
    "flt_needs_resegmentation": (q_gate, SQL_GATE),
    "flt_chapter_title": (q_title, oracle(f"SELECT doc_id, idx, regexp_matches(regexp_replace(text, '{T}', '', 'g'), '{segment.TITLE}') AS is_title FROM paragraphs".replace("[\\s\\S]", "[\\x00-\\x{10FFFF}]"))),
    "flt_short_paragraph": (q_short, oracle(f"SELECT doc_id, idx, length({NORM}) < {dedup.MIN_LENGTH} AS dedup_short, length(text) < {segment.MIN_PARAGRAPH} AS merge_short FROM paragraphs")),
    "flt_valid_repair": (q_valid_repair_rows, SQL_VALID_REPAIR),
    "flt_valid_repair_all": (q_valid_repair, f"SELECT verdict, count(*) AS n FROM ({SQL_VALID_REPAIR}) GROUP BY verdict"),
    "flt_bad_rewrite": (q_bad_rewrite, SQL_BAD_REWRITE),
    "flt_error_class": (q_error_class, oracle(f"SELECT id, regexp_matches(concat(details, action, CAST(id AS STRING)), '{review.RETRYABLE}') AS retryable FROM logs")),
    "gen_paragraphs": (q_paragraphs, oracle("SELECT doc_id, idx, text FROM paragraphs")),
    "gen_baseline_lines": (lambda s, d: lines(s, d), oracle("SELECT doc_id, idx, text FROM lines")),
    "gen_resegment": (q_resegment, None),
    "gen_merge_short": (q_merge_short, SQL_MERGE_SHORT),
    "gen_split_chapter_titles": (lambda s, d: digest(segment.split_chapter_titles(view(s, d, "seeded"))), None),
    "gen_chunks": (q_chunks, None),
    "gen_paragraph_diff": (q_paragraph_diff, SQL_PARAGRAPH_DIFF),
    "join_near_dup": (q_near_dup, SQL_NEAR_DUP),
    "join_near_paragraphs": (q_near_paragraphs, SQL_NEAR_PARAGRAPHS),
    "join_apply_review": (q_apply_review, SQL_APPLY_REVIEW),
    "join_dup_to_lines": (q_dup_to_lines, SQL_DUP_TO_LINES),
    "join_changed_rows": (q_changed_rows, SQL_CHANGED_ROWS),
    "join_file_rules": (q_join_file_rules, SQL_JOIN_FILE_RULES),
    "join_apply_suggestions": (q_apply_suggestions, SQL_APPLY_SUGGESTIONS),
    "agg_dup_stats": (flagship, SQL_FLAGSHIP),
    "agg_join_paragraphs": (q_join_paragraphs, f"SELECT {DIGEST} FROM documents"),
    "agg_merge_chunks": (q_merge_chunks, f"SELECT {DIGEST} FROM documents"),
    "win_exact_dup": (q_exact_dup, oracle(f"SELECT doc_id, idx, is_dup, CASE WHEN is_dup THEN first_idx END AS first_idx FROM ({EXACT})")),
    "set_review_union": (q_review_union, SQL_REVIEW_UNION),
    "fn_local_vector": (q_local_vector, SQL_LOCAL_VECTOR),
    "fn_cosine": (q_cosine, oracle(f"SELECT a.idx, round({COS.format('a.vec', 'b.vec')}, 6) AS cosine FROM vectors a JOIN vectors b ON a.idx = b.idx + 1")),
    "fn_levenshtein": (q_levenshtein, oracle(f"SELECT doc_id, idx, {DISTANCE} AS distance FROM (SELECT doc_id, idx, original AS o, suggested AS s FROM repairs)")),
    "fn_positional_similarity": (q_positional, SQL_POSITIONAL),
    "fn_normalize_paragraph": (lambda s, d: paragraphs(s, d).select("doc_id", "idx", fn.normalize_paragraph(F.col("text")).alias("norm")), oracle(f"SELECT doc_id, idx, {NORM} AS norm FROM paragraphs")),
    "fn_utrim": (lambda s, d: digest(view(s, d, "seeded").withColumn("text", fn.utrim(F.concat(F.lit("　 "), "text", F.lit("  "))))), sql_text(f"regexp_replace(concat('　 ', text, chr(160), chr(8195)), '{T}', '', 'g')")),
    "fn_parse_filename": (
        lambda s, d: view(s, d, "files").select("id", F.explode(F.array("file_name", F.concat(F.lit("a very long author name·"), "file_name"), F.md5("file_name"))).alias("f")).select("id", "f", fn.parse_filename(F.col("f")).alias("p")).select("id", "f", "p.author", "p.title"),
        oracle(
            "SELECT id, file_name AS f, author, CAST(id AS STRING) AS title FROM files UNION ALL SELECT id, 'a very long author name·' || file_name, CAST(id AS STRING), 'a very long author name·' || author FROM files UNION ALL SELECT id, md5(file_name), '', md5(file_name) FROM files"
        ),
    ),
    "fn_content_md5": (lambda s, d: view(s, d, "seeded").select("doc_id", fn.content_md5(F.col("text")).alias("md5")), oracle("SELECT doc_id, md5(text) AS md5 FROM seeded")),
}
