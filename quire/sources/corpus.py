"""Raw text files, rule files, and what is written back."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quire.functions.text import parse_filename
from quire.sources.files import write_files

MAX_SIZE = 100 << 20
# The rules that apply if there is no rule file.
DEFAULT_RULES = (("1", "广告清理", "本文由[^\\n]*提供", "", "清理常见的广告文本", True), ("2", "错别字修正", "名子", "名字", "修正常见错别字", True))
RULES_SCHEMA = "id string, name string, pattern string, replacement string, description string, enabled boolean"


def read_corpus(spark: SparkSession, path: str, max_size: int = MAX_SIZE) -> DataFrame:
    """path, modificationTime, length, content of all .txt files below a folder, up to a size."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[tT][xX][tT]").option("recursiveFileLookup", "true").load(path)
    return files.filter(F.col("length") <= max_size)


def _decoded(line: bytes) -> tuple[str, str]:
    for name in ("gbk", "gb18030"):
        try:
            return line.decode(name), name
        except UnicodeDecodeError:
            pass
    return line.decode("utf-8", "ignore"), "dropped"


def decode_corpus(files: DataFrame, key: str = "path") -> DataFrame:
    """(path, content) -> (path, line_no, text, encoding): each line as UTF-8, else GBK, else GB18030, else without its invalid bytes.

    A line end never lies inside a character of these encodings. Only lines that are not UTF-8 go to Python.
    """
    raw = F.decode("content", "ISO-8859-1")
    lines = files.select(key, F.posexplode(F.split(raw, "\n")).alias("line_no", "raw")).withColumn("line", F.encode("raw", "ISO-8859-1"))
    valid = F.is_valid_utf8(F.col("line").cast("string"))
    good = lines.filter(valid).select(key, "line_no", F.col("line").cast("string").alias("text"), F.lit("utf-8").alias("encoding"))

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [_decoded(bytes(x)) for x in frame.line]
            yield frame[[key, "line_no"]].assign(text=[t for t, _ in found], encoding=[e for _, e in found])

    kind = files.schema[key].dataType.simpleString()
    bad = lines.filter(~valid).select(key, "line_no", "line").mapInPandas(scan, f"{key} {kind}, line_no int, text string, encoding string")
    return good.unionByName(bad)


@F.pandas_udf(StringType())
def _decoded_whole(content: pd.Series) -> pd.Series:
    def one(raw) -> str | None:
        if raw is None:
            return None
        lines = []
        for line in bytes(raw).split(b"\n"):
            try:
                lines.append(line.decode())
            except UnicodeDecodeError:
                lines.append(_decoded(line)[0])
        return "\n".join(lines)

    return content.map(one)


def decoded(content: Column) -> Column:
    """The text of a file's bytes: UTF-8 if all of it is, else line by line as `decode_corpus` does. Only such files go to Python."""
    valid = F.is_valid_utf8(content.cast("string"))
    return F.coalesce(F.when(valid, content.cast("string")), _decoded_whole(F.when(~valid, content)))


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("encoding", StringType())]))
def _decoded_lines(lines: pd.Series) -> pd.DataFrame:
    found = [(None, None) if x is None else _decoded(bytes(x)) for x in lines]
    return pd.DataFrame(found, columns=["text", "encoding"])


def file_catalog(files: DataFrame) -> DataFrame:
    """(path, content) -> md5, size, file_name, author, title."""
    name = F.regexp_extract("path", r"([^/]*)\z", 1)
    parsed = parse_filename(name)
    return files.select(F.md5("content").alias("md5"), F.octet_length("content").cast("long").alias("file_size"), name.alias("file_name"), parsed["author"].alias("author"), parsed["title"].alias("title"))


def rules_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Rules of a JSON array file, or the two default ones."""
    if path is None:
        return spark.createDataFrame(list(DEFAULT_RULES), RULES_SCHEMA)
    return spark.read.option("multiLine", True).schema(RULES_SCHEMA).json(path)


# The defaults of a file's rules.
RULE_DEFAULTS = {"enableBasicCleaning": True, "enableAdCleaning": True, "traditionalToSimple": True, "enableVectorDetection": True, "enableModelRepair": True, "enableParagraphReconstruct": False}
DEFAULT_THRESHOLD = 0.95


def file_rules(config: Column) -> Column:
    """A file's rule JSON as struct, with defaults for missing fields; bad JSON counts as none.

    typo_map is an object or `a=b,c=d`, ad_blacklist an array or `x,y`; a threshold of 0 or less is the default.
    """
    at = lambda name: F.get_json_object(config, f"$.{name}")
    flags = [F.coalesce(F.when(at(n) == "true", True).when(at(n) == "false", False), F.lit(d)).alias(n) for n, d in RULE_DEFAULTS.items()]
    threshold = at("similarityThreshold").try_cast("double")
    typos, ads = at("typoMap"), at("adBlacklist")
    pairs = F.filter(F.transform(F.split(typos, ","), lambda p: F.transform(F.split(p, "=", 2), lambda x: F.btrim(x))), lambda p: F.size(p) == 2)
    listed = F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.get(p, F.lit(0)), F.get(p, F.lit(1)))))
    empty = F.expr("cast(map() as map<string,string>)")
    typo_map = F.when(typos.startswith("{"), F.from_json(typos, "map<string,string>")).when(typos.isNull() | (typos == ""), empty).otherwise(listed)
    blacklist = F.when(ads.startswith("["), F.from_json(ads, "array<string>")).when(ads.isNull(), F.expr("cast(array() as array<string>)")).otherwise(F.filter(F.transform(F.split(ads, ","), lambda x: F.btrim(x)), lambda x: x != ""))
    return F.struct(
        *flags,
        F.when(threshold > 0, threshold).otherwise(F.lit(DEFAULT_THRESHOLD)).alias("similarityThreshold"),
        F.coalesce(typo_map, empty).alias("typo_map"),
        F.coalesce(blacklist, F.expr("cast(array() as array<string>)")).alias("ad_blacklist"),
    )


def with_file_rules(docs: DataFrame, rules: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs with `r`, the parsed rules (key, r) of their files; a file without rules has the defaults. Rules are joined by the key: there is
    a row a file, so they grow with the documents and are broadcast only if Spark finds them small."""
    return docs.join(rules.select(key, "r"), key, "left").withColumn("r", F.coalesce("r", file_rules(F.lit(""))))


def step_versions(texts: DataFrame, step: str, versions: DataFrame) -> DataFrame:
    """Version rows for a step's texts (file_id, content): MD5 of the content, parent the newest version so far, else the file."""
    newest = versions.groupBy("original_id").agg(F.max_by("version_id", F.struct("created_at", "id")).alias("parent_id"))
    # The MD5 is taken before the join, so that no text moves.
    rows = texts.select("file_id", F.md5(F.col("content").cast("binary")).alias("version_md5")).join(newest, F.col("file_id") == F.col("original_id"), "left")
    return rows.select("file_id", F.lit(step).alias("step"), "version_md5", F.coalesce("parent_id", "file_id").alias("parent_id"))


def _committed(spark: SparkSession, path: str) -> list[str]:
    """The attempts below a folder that wrote their mark."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/attempt=*/_SUCCESS")
    found = jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(jvm)
    return sorted(f.getPath().getParent().toString() for f in found or [])


VERSIONS = "file_id long, step string, version_md5 string, parent_id long"


def read_versions(spark: SparkSession, base: str) -> DataFrame:
    """The version rows of finished attempts, with the attempt that has their texts."""
    paths = _committed(spark, f"{base}/versions")
    if not paths:
        return spark.createDataFrame([], VERSIONS + ", attempt string")
    return spark.read.schema(VERSIONS + ", attempt string").option("basePath", f"{base}/versions").parquet(*paths)


STEP_KEY = ["file_id", "step", "version_md5"]


def read_step_texts(spark: SparkSession, base: str) -> DataFrame:
    """(file_id, step, version_md5, content) of all version rows; texts of attempts that did not finish are not seen.

    An attempt's texts are those of its version rows, so the marks of its two folders tell what is to be seen, and no text moves.
    """
    finished = {p.rsplit("/", 1)[-1] for p in _committed(spark, f"{base}/versions")}
    paths = [p for p in _committed(spark, f"{base}/texts") if p.rsplit("/", 1)[-1] in finished]
    if not paths:
        return spark.createDataFrame([], "file_id long, step string, version_md5 string, content string")
    texts = spark.read.schema("file_id long, step string, version_md5 string, content string").parquet(*paths)
    return texts.filter(" and ".join(f"{k} is not null" for k in STEP_KEY))  # what lacks one has no version row


def write_step(texts: DataFrame, step: str, versions: DataFrame, base: str) -> None:
    """A step's texts (file_id, content) and their version rows below `base`, in two parts: the texts into a folder of this attempt, and
    only when all of them are there the version rows, whose folder's mark makes both visible. What has a version row for its file, step
    and MD5 already is not written again, so a repeated step adds nothing, and one that was cut off leaves nothing to be seen."""
    spark = texts.sparkSession
    attempt = uuid.uuid4().hex
    known = read_versions(spark, base).select(*STEP_KEY)
    bodies = texts.select(F.col("file_id").cast("long").alias("file_id"), F.lit(step).alias("step"), F.md5(F.col("content").cast("binary")).alias("version_md5"), "content")
    # Keys are counted first: where all texts are new, or none is, as in most steps, no text moves.
    keys = bodies.select(*STEP_KEY).groupBy(*STEP_KEY).agg(F.count(F.lit(1)).alias("rows_"))
    found = keys.join(known.distinct().withColumn("known_", F.lit(True)), STEP_KEY, "left").agg(F.count_if(F.col("known_").isNull()).alias("new"), F.sum("rows_").alias("rows")).first()
    if not found["new"]:
        return
    if found["new"] < found["rows"]:
        bodies = bodies.join(known, STEP_KEY, "left_anti").dropDuplicates(STEP_KEY)
    bodies.write.parquet(f"{base}/texts/attempt={attempt}")
    written = spark.read.schema("file_id long, step string, version_md5 string, content string").parquet(f"{base}/texts/attempt={attempt}").select(*STEP_KEY)
    rows = step_versions(texts, step, versions).select(F.col("file_id").cast("long").alias("file_id"), "step", "version_md5", F.col("parent_id").cast("long").alias("parent_id"))
    rows.dropDuplicates(STEP_KEY).join(written, STEP_KEY).write.parquet(f"{base}/versions/attempt={attempt}")


def write_final(texts: DataFrame, path: str) -> None:
    """(file_id, content): one file a row, named by the id; see `files.write_files`."""
    write_files(texts.select(F.concat(F.col("file_id").cast("string"), F.lit(".txt")).alias("name"), "content"), path)


def decode_lines(lines: DataFrame) -> DataFrame:
    """(path, start, line) -> (path, start, text, encoding), by the rule of `decode_corpus`. Lines of one file may be in many tasks."""
    text = F.col("line").cast("string")
    valid = F.is_valid_utf8(text)
    other = _decoded_lines(F.when(~valid, F.col("line")))
    return lines.withColumn("other_", other).select("path", "start", F.when(valid, text).otherwise(F.col("other_.text")).alias("text"), F.when(valid, "utf-8").otherwise(F.col("other_.encoding")).alias("encoding"))


def report(files: DataFrame, review: DataFrame, logs: DataFrame, versions: DataFrame) -> DataFrame:
    """Per file: its fields, review totals, logs and versions in order, as one nested row."""
    totals = review.groupBy("file_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") != "pending").alias("resolved"))
    log_list = logs.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("ts", "id", "action"))).alias("logs"))
    version_list = versions.groupBy(F.col("original_id").alias("file_id")).agg(F.array_sort(F.collect_list(F.struct("created_at", "version_id", "version_type"))).alias("versions"))
    return files.withColumnRenamed("id", "file_id").join(totals, "file_id", "left").join(log_list, "file_id", "left").join(version_list, "file_id", "left")


def rules_json() -> str:
    """The default rules as the text of a rule file."""
    names = [c.split()[0] for c in RULES_SCHEMA.split(", ")]
    return json.dumps([dict(zip(names, r)) for r in DEFAULT_RULES], ensure_ascii=False)
