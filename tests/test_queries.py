"""Every registered query against its SQL in DuckDB, and streams against their batch twins."""

import os
import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from quire.functions.text import MARKS, distance, edit_distance, local_vector
from quire.operators import dedup, health, segment
from quire.plans import registry
from quire.plans.table_queries import LIMIT, SECONDS
from quire.plans.text_queries import SQL_SRC_CORPUS, q_src_corpus, step_cleaning
from quire.plans.views import review, view

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()]
    assert sorted(map(repr, rows)) == sorted(map(repr, want))


def same(a, b):
    return sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_streams_equal_batches(spark, sf_dir):
    q = registry.queries()
    assert same(q["st_health"](spark, sf_dir), health.health_ema(view(spark, sf_dir, "checks")))
    assert same(q["st_quota"](spark, sf_dir), health.quota(view(spark, sf_dir, "requests"), LIMIT, SECONDS))


def test_merged_chunks_give_the_documents_back(spark, sf_dir):
    got = {r.doc_id: r.text_md5 for r in registry.queries()["agg_merge_chunks"](spark, sf_dir).collect()}
    want = {r.doc_id: r.text_md5 for r in registry.queries()["agg_join_paragraphs"](spark, sf_dir).collect()}
    assert got == want


@pytest.mark.parametrize("max_size", [10_000, 20_000])
def test_no_raw_file_is_over_the_limit(spark, duck, sf_dir, max_size):
    got = {r.part: r.bytes for r in q_src_corpus(spark, sf_dir, max_size).collect()}
    assert got == dict(duck.execute(SQL_SRC_CORPUS).fetchall())


def test_every_document_comes_back_whole_from_its_chunks(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in view(spark, sf_dir, "plain").collect()] + [(-1, "same line\n" * 700), (-2, "x" * 2500), (-3, "é。" * 3000), (-4, "")]
    cut = segment.chunks(spark.createDataFrame(docs, "doc_id long, text string"), 1000, 100)
    assert {r.doc_id: r.text for r in segment.merge_chunks(cut).collect()} == dict(docs)


def test_rewritten_chunks_still_merge_by_their_texts(spark):
    df = spark.createDataFrame([(1, 0, 0, 60, "a" * 30 + "b" * 30), (1, 1, 30, 90, "b" * 30 + "c" * 31), (1, 2, 80, 100, "new")], "doc_id int, chunk_id int, start int, end int, text string")
    assert segment.merge_chunks(df).first().text == "a" * 30 + "b" * 30 + "c" * 31 + "\nnew"


def test_near_paragraphs_against_brute_force(spark):
    texts = ["第一段的内容在这里，说了一些话。", "other words here", "第一段的内容在这里，说了一些话。", "短", "第一段的内容在这里说了一些话", "y" * 300, "", "y" * 301]
    df = spark.createDataFrame([(d, i, t) for d in (1, 2) for i, t in enumerate(texts)], "doc_id long, idx int, text string")
    vec = {r.idx: r.v for r in df.filter("doc_id = 1").select("idx", local_vector(F.col("text")).alias("v")).collect()}
    norm = {i: t.translate({ord(c): None for c in MARKS}).strip() for i, t in enumerate(texts)}
    part = [i for i, t in norm.items() if len(t) >= 5 and t not in [norm[j] for j in range(i)]]
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    for threshold in (0.95, 0.7):
        want = {}
        for i in part:
            near = [j for j in part if j < i and cos(vec[i], vec[j]) >= threshold]
            if near:
                want[i] = max(near)
        got = dedup.near_paragraphs(df, threshold=threshold).collect()
        assert {(r.doc_id, r.idx): r.near_idx for r in got} == {(d, i): j for d in (1, 2) for i, j in want.items()}


def test_cleaning_step_by_rules_of_a_file(spark):
    """Each flag acts for its part; the rest is the jobs one after the other."""
    text = "臺灣國語，她因该 the ernd 他说:你好,世界!" + "长句子在这里没有换行。" * 30
    configs = ["", '{"enableBasicCleaning":false}', '{"traditionalToSimple":false}', '{"adBlacklist":"er[a-z]+,(bad","typoMap":"the=THE"}', '{"enableAdCleaning":false,"adBlacklist":"er","typoMap":"the=THE"}', "{bad"]
    df = spark.createDataFrame([(i, text, c) for i, c in enumerate(configs)], "doc_id long, text string, config string")
    got = {r.doc_id: r.text for r in step_cleaning(df, [("你好", "您好")], "config").collect()}
    base = got[0]
    assert got[1] == text and got[4] == base == got[5] and "台湾国语" in base and "您好，世界！" in base and base.count("\n\n") == 0
    assert "臺灣國語" in got[2] and got[2].replace("臺灣國語", "台湾国语") == base
    assert got[3] == base.replace("ernd", "").replace("the", "THE")
    assert {r.text for r in step_cleaning(df.drop("config"), [("你好", "您好")]).collect()} == {base}


def test_newlines_fixed_equals_the_jobs(spark, sf_dir):
    docs = view(spark, sf_dir, "seeded").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, "他走了。第二天又来了。" * 30), (-2, None), (-3, "")], "doc_id long, text string")).cache()
    gate = F.coalesce(segment.needs_resegmentation(F.col("text")), F.lit(False))
    cut = segment.join_paragraphs(segment.resegment(docs.filter(gate)), "\n\n")
    want = segment.split_chapter_titles(cut.unionByName(docs.filter(~gate)))
    assert {tuple(r) for r in segment.newlines_fixed(docs).collect()} == {tuple(r) for r in want.collect()}


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_distances_of_whole_texts(spark, sf_dir):
    same = "où est la bibliothèque? 中文 " * 20
    pairs = [("", ""), ("", "é"), ("kitten", "sitting"), (same, same + "x"), (same, same[:100] + "ü" + same[103:]), (same, same[::-1]), ("a" * 300, "b" * 290), ("😀é", "é😀"), ("x" * 17 + same, same)]
    got = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string").select("i", edit_distance(F.col("a"), F.col("b"))).collect()
    assert dict(map(tuple, got)) == {i: brute_distance(a, b) for i, (a, b) in enumerate(pairs)}
    rows = registry.queries()["fn_levenshtein"](spark, sf_dir).collect()
    assert len(rows) == review(spark, sf_dir).count() and len({r.distance for r in rows}) > 50
    assert {r.verdict for r in registry.queries()["flt_valid_repair_all"](spark, sf_dir).collect()} == {"ok", "empty", "moved_mark", "short_changed", "length", "distance"}


def test_the_cleaning_step_is_written_out_once(spark, sf_dir):
    for name in ("cl_step_columns", "cl_step_cleaning"):
        plan = registry.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all(") <= 10  # four kinds of garbled runs


def test_distances_by_bits(spark):
    rng = random.Random(5)
    some = lambda n: "".join(rng.choice("abé中😀") for _ in range(n))
    for _ in range(300):
        a, b = some(rng.randint(0, 40)), some(rng.randint(0, 40))
        b = rng.choice([b, a[: len(a) // 2] + b[:3] + a[len(a) // 2 + 2 :], a])
        assert distance(a, b) == distance(b, a) == brute_distance(a, b)
    a = "".join(rng.choice("abcdefgh ") for _ in range(40_000))
    began = time.perf_counter()
    assert 0 < distance(a, a.replace(" ", "")) <= a.count(" ") and distance("x" + a, a + "y") == 2
    assert time.perf_counter() - began < 20
    df = spark.createDataFrame([(None, "a"), ("a", None), ("ab", "b")], "a string, b string")
    assert [r[0] for r in df.select(edit_distance(F.col("a"), F.col("b"))).collect()] == [None, None, 1]


def test_python_tasks_get_batches_of_few_rows(spark, sf_dir):
    view(spark, sf_dir, "plain")
    sizes = spark.range(0, 5000, 1, 1).mapInPandas(lambda frames: (f.assign(id=len(f)).head(1) for f in frames), "id long")
    assert max(r.id for r in sizes.collect()) <= 1000
