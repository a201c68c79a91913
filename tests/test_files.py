"""Reading by ranges of lines, one file a row, and steps written in two parts."""

import io

import pytest
from pyspark.sql import functions as F

from quire.sources import corpus, files

MIXED = "第一行文字\n".encode() + "第二行内容\n".encode("gbk") + b"\n" + "𠀀字".encode("gb18030") + b"\n\xff\xfe\nplain\r\n"


@pytest.mark.parametrize("body", [MIXED, MIXED + "无换行".encode(), b"", b"\n", b"\n\n\n", b"x" * 40])
def test_every_cut_gives_the_same_lines(body):
    want, at = [], 0
    for line in body.split(b"\n"):
        want.append((at, line))
        at += len(line) + 1
    for size in range(1, len(body) + 2):
        got = []
        for start in range(0, len(body) + 1, size):
            got += files.lines_between(io.BytesIO(body), start, min(start + size, len(body) + 1), read=7)
        assert got == want, size


@pytest.mark.parametrize("size", [5, 16, 1 << 20])
def test_lines_of_files_equal_whole_files(spark, tmp_path, size):
    for name, body in (("a.txt", MIXED), ("sub/b.TXT", "全部\nUTF-8".encode()), ("c.md", b"no"), ("d.txt", b"")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    got = {}
    lines = files.read_lines(spark, f"file://{tmp_path}", size)
    assert size > 5 or lines.rdd.getNumPartitions() > 5
    for r in corpus.decode_lines(lines).orderBy("path", "start").collect():
        got.setdefault(r.path.rsplit("/", 1)[-1], []).append((r.text, r.encoding))
    want = {}
    for r in corpus.decode_corpus(corpus.read_corpus(spark, str(tmp_path))).orderBy("path", "line_no").collect():
        want.setdefault(r.path.rsplit("/", 1)[-1], []).append((r.text, r.encoding))
    assert got == {**want, "d.txt": [("", "utf-8")]} and {e for rows in got.values() for _, e in rows} == {"utf-8", "gbk", "gb18030", "dropped"}
    whole = corpus.read_corpus(spark, str(tmp_path)).select(F.regexp_extract("path", "([^/]*)$", 1).alias("p"), corpus.decoded(F.col("content")).alias("t")).collect()
    assert {r.p: r.t for r in whole} == {p: "\n".join(t for t, _ in rows) for p, rows in want.items()}


def test_one_file_a_row(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    texts = spark.createDataFrame([(i, f"text {i}\né\n") for i in range(25)], "file_id long, content string").repartition(3)
    corpus.write_final(texts, path)
    got = {r.name: r.content for r in files.read_files(spark, path).collect()}
    assert got == {f"{i}.txt": f"text {i}\né\n" for i in range(25)}
    assert len([p for p in (tmp_path / "out").iterdir() if p.is_dir()]) == 3 and not list((tmp_path / "out").glob("_attempt*"))


def test_reading_files_has_a_task_for_each_that_wrote(spark, tmp_path):
    """The number of tasks does not grow with that of files; empty files, and names that Spark's reader hides, have a row too."""
    path = f"file://{tmp_path}/out"
    texts = spark.createDataFrame([(i, f"text {i}" if i % 50 else "") for i in range(300)], "file_id long, content string").repartition(2)
    corpus.write_final(texts, path)
    named = spark.createDataFrame([("_a b%20é.txt", bytearray(b"\xffx\n")), ("b.md", bytearray(b"no"))], "name string, content binary").coalesce(1)
    files.write_files(named, path)
    (tmp_path / "out" / "_attempt-cut").mkdir()
    (tmp_path / "out" / "_attempt-cut" / "9.txt").write_text("not committed")
    back = files.read_files(spark, path)
    assert back.rdd.getNumPartitions() == 3 and back.schema.simpleString() == "struct<name:string,content:string>"
    got = {r.name: bytes(r.c) for r in back.select("name", F.col("content").cast("binary").alias("c")).collect()}
    assert got == {f"{i}.txt": f"text {i}".encode() if i % 50 else b"" for i in range(300)} | {"_a b%20é.txt": b"\xffx\n"}
    (tmp_path / "none").mkdir()
    assert files.read_files(spark, f"file://{tmp_path}/none").count() == 0


def test_a_failed_write_leaves_no_files(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    texts = spark.createDataFrame([(i, "x") for i in range(8)], "file_id long, content string").repartition(2)
    bad = texts.withColumn("content", F.when(F.col("file_id") == 7, F.raise_error(F.lit("no"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="no"):
        corpus.write_final(bad, path)
    assert not [p for p in (tmp_path / "out").rglob("*.txt")] if (tmp_path / "out").exists() else True
    corpus.write_final(texts, path)
    assert files.read_files(spark, path).count() == 8


def test_steps_are_written_once_and_only_whole(spark, tmp_path):
    base = f"file://{tmp_path}/steps"
    versions = spark.createDataFrame([(1, 1, 10, 5), (2, 1, 11, 6)], "id long, original_id long, version_id long, created_at long")
    one = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "file_id long, content string")
    for _ in range(2):
        corpus.write_step(one, "cleaning", versions, base)
    got = lambda: sorted((r.file_id, r.step, r.content) for r in corpus.read_step_texts(spark, base).collect())
    assert got() == [(1, "cleaning", "a"), (2, "cleaning", "b")]
    assert {r.file_id: r.parent_id for r in corpus.read_versions(spark, base).collect()} == {1: 11, 2: 2}
    corpus.write_step(spark.createDataFrame([(1, "a"), (2, "c")], "file_id long, content string"), "cleaning", versions, base)
    corpus.write_step(one, "final", versions, base)
    assert got() == [(1, "cleaning", "a"), (1, "final", "a"), (2, "cleaning", "b"), (2, "cleaning", "c"), (2, "final", "b")]
    # An attempt that ended between its texts and its version rows is not seen, and the step can be done again.
    (tmp_path / "steps/texts/attempt=cut").mkdir()
    spark.createDataFrame([(9, "cleaning", "m", "lost")], "file_id long, step string, version_md5 string, content string").write.mode("overwrite").parquet(f"{base}/texts/attempt=cut")
    assert len(got()) == 5
    (tmp_path / "steps/versions/attempt=half").mkdir()
    (tmp_path / "steps/versions/attempt=half/part-0.parquet").write_bytes(b"not whole")
    assert len(got()) == 5


def test_a_step_moves_no_text_unless_it_must(spark, tmp_path, capsys):
    versions = spark.createDataFrame([], "id long, original_id long, version_id long, created_at timestamp")
    base, shape = f"file://{tmp_path}/steps", "file_id long, content string"
    attempts = lambda: len(list((tmp_path / "steps" / "texts").iterdir()))
    first = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (None, "n")], shape)
    corpus.write_step(first, "cleaning", versions, base)
    # The same again writes nothing, not even an empty attempt; without the rows that have no key no text is new.
    again = first.filter("file_id is not null and content is not null")
    corpus.write_step(again, "cleaning", versions, base)
    assert attempts() == 1
    # Some known, some new, one given twice.
    corpus.write_step(spark.createDataFrame([(1, "a"), (2, "c"), (2, "c"), (4, "d")], shape), "cleaning", versions, base)
    assert attempts() == 2
    back = corpus.read_step_texts(spark, base)
    assert sorted((r.file_id, r.content) for r in back.collect()) == [(1, "a"), (2, "b"), (2, "c"), (4, "d")]
    back.explain()
    shown = capsys.readouterr().out
    assert "Exchange" not in shown and "Join" not in shown
    # An attempt whose version rows are not there is not seen.
    next((tmp_path / "steps" / "versions").iterdir()).joinpath("_SUCCESS").unlink()
    assert corpus.read_step_texts(spark, base).count() == 2
