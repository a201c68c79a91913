"""Golden cases: small inputs with stated results."""

import datetime as dt
import math
import random
import re
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.functions import text as fn
from quire.functions.patterns import pattern
from quire.operators import catalog, clean, dedup, health, review, segment
from quire.plans import registry
from quire.sources import corpus


def one(spark, texts, job, *columns):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = {r.doc_id: r for r in job(df).collect()}
    return [rows[i][columns[0]] if columns else rows[i].text for i in range(len(texts))]


def values(spark, texts, expr):
    return one(spark, texts, lambda df: df.withColumn("v", expr(F.col("text"))), "v")


def test_normalize_and_trim(spark):
    got = values(spark, ["你好，世界！这是一个测试。", "  你好世界  ", "（3）", "3", "★ ★ ★ ★ ★", "★    ★    ★    ★    ★"], fn.normalize_paragraph)
    assert got[:2] == ["你好世界这是一个测试", "你好世界"] and got[2] != got[3] and got[4] != got[5]
    assert values(spark, ["　 x y  ", None, ""], fn.utrim) == ["x y", None, ""]


def test_duplicates(spark):
    df = spark.createDataFrame([(0, i, t) for i, t in enumerate(["这是第一个很长的段落内容", "另一个段落的内容在这里", "这是第一个很长的段落内容", "（1）", "（1）"])], "doc_id int, idx int, text string")
    assert [r.idx for r in dedup.exact_duplicates(df).filter("is_dup").collect()] == [2]
    vecs = [(1, i, [float(x) for x in v]) for i, v in enumerate([(1, 0, 0), (1, 0.01, 0), (0, 1, 0), (0, 0, 1), (0, 0, 0)])]
    near = dedup.near_duplicates(spark.createDataFrame(vecs, "file_id int, idx int, vec array<double>"))
    assert [(r.i, r.j) for r in near.collect()] == [(1, 0)]
    many = spark.createDataFrame([(1, i, [1.0, float(i % 7 == 0)]) for i in range(80)], "file_id int, idx int, vec array<double>")
    want = {(i, j) for i in range(80) for j in range(i) if i - j <= 9 and (i % 7 == 0) == (j % 7 == 0)}
    assert {(r.i, r.j) for r in dedup.near_duplicates(many, window=9).collect()} == want
    assert dedup.near_duplicates(many, window=0).count() == sum(1 for i in range(80) for j in range(i) if (i % 7 == 0) == (j % 7 == 0))


def test_duplicate_stats_caps_the_report_only(spark):
    df = spark.createDataFrame([(0, i, "段" * 10) for i in range(25)] + [(1, i, "x" * 400) for i in range(15)] + [(2, 0, "y")], "doc_id int, idx int, text string")
    got = {r.doc_id: (r.n, r.chars, len(r.samples), r.truncated) for r in dedup.duplicate_stats(df).collect()}
    assert got == {0: (25, 250, 20, True), 1: (15, 6000, 10, True), 2: (1, 1, 1, False)}


def test_decode(spark):
    utf, gbk = "第一行文字", "第二行内容"
    rows = [("a", utf.encode() + b"\n" + gbk.encode("gbk") + b"\n" + utf.encode()), ("b", b""), ("c", "𠀀字".encode("gb18030"))]
    got = {}
    for r in corpus.decode_corpus(spark.createDataFrame(rows, "path string, content binary")).orderBy("line_no").collect():
        got.setdefault(r.path, []).append(r.text)
    assert got == {"a": [utf, gbk, utf], "b": [""], "c": ["𠀀字"]}


def test_read_corpus(spark, tmp_path):
    for name, body in (("张三-书名.txt", b"abc"), ("b.TXT", b"x" * 50), ("c.md", b"no")):
        (tmp_path / name).write_bytes(body)
    files = corpus.read_corpus(spark, str(tmp_path), 20)
    assert [r.length for r in files.collect()] == [3]
    row = corpus.file_catalog(corpus.read_corpus(spark, str(tmp_path))).filter("file_size = 3").first()
    assert (row.author, row.title, row.md5) == ("张三", "书名", "900150983cd24fb0d6963f7d28e17f72")


def test_garbled_and_entities(spark):
    assert one(spark, ["正常文本锟斤拷锟斤拷更多正常文本", "a�b", "a���b"], clean.garbled) == ["正常文本[因无法修复的乱码删除了6个字符]更多正常文本", "a�b", "a[因无法修复的乱码删除了3个字符]b"]
    assert one(spark, ["&lt;a&gt;&amp;lt;&nbsp;x&#8203;y", None], clean.html_entities) == ["<a>&lt; xy", None]


def test_punctuation_by_context(spark):
    got = one(spark, ["你好,world", "hello, world.", "abc好de.f", "x.中", "x..中", "(好)[不]"], clean.cjk_punct)

    def brute(t):
        han = lambda c: "一" <= c <= "鿿"
        return "".join(clean.FULL[clean.HALF.index(c)] if c in clean.HALF and any(map(han, t[max(0, i - 3) : i + 3])) else c for i, c in enumerate(t))

    assert got == [brute(t) for t in ["你好,world", "hello, world.", "abc好de.f", "x.中", "x..中", "(好)[不]"]]


CHAPTERS = [
    ("这是前面的内容◇ 五 ◇这是后面的内容", "这是前面的内容\n\n◇ 五 ◇\n\n这是后面的内容"),
    ("这是前面的内容第五章这是后面的内容", "这是前面的内容\n\n第五章\n\n这是后面的内容"),
    ("开头◇ 一 ◇第一章内容◇ 二 ◇第二章内容", "开头\n\n◇ 一 ◇\n\n第一章\n\n内容\n\n◇ 二 ◇\n\n第二章\n\n内容"),
    ("前面内容\n◇ 三 ◇\n后面内容", "前面内容\n◇ 三 ◇\n后面内容"),
    ("开头◇ 一 ◇第一章内容第五章第二章内容", "开头\n\n◇ 一 ◇\n\n第一章\n\n内容\n\n第五章\n\n第二章\n\n内容"),
]


def test_chapters(spark):
    assert one(spark, [a for a, _ in CHAPTERS], clean.post_chapters) == [b for _, b in CHAPTERS]


def test_post_punct(spark):
    assert one(spark, ["a,b.c 3.14!!?", "好。。，，"], clean.post_punct) == ["a，b。c 3.14！？", "好。，"]


def test_file_rules(spark):
    configs = ['{"typoMap":"名子=名字,在坐=在座"}', '{"typoMap":""}', "{}", "", "{bad", '{"typoMap":{"a":"b"},"adBlacklist":["x"],"similarityThreshold":-1,"enableAdCleaning":false}', '{"adBlacklist":"广告1,广告2,广告3","similarityThreshold":0.8}']
    got = values(spark, configs, corpus.file_rules)
    assert [r.typo_map for r in got] == [{"名子": "名字", "在坐": "在座"}, {}, {}, {}, {}, {"a": "b"}, {}]
    assert [list(r.ad_blacklist) for r in got][5:] == [["x"], ["广告1", "广告2", "广告3"]]
    assert [r.similarityThreshold for r in got] == [0.95] * 6 + [0.8] and not got[5].enableAdCleaning and got[4].enableAdCleaning


def test_typos_and_blacklist(spark):
    df = spark.createDataFrame([(0, "cat concat 他cat好 a+b", {"cat": "dog$1", "a+b": "c"}, ["他", ""]), (1, "名子", {"名子": "名字"}, [])], "doc_id int, text string, typo_map map<string,string>, ad_blacklist array<string>")
    rows = {r.doc_id: r.text for r in clean.ad_blacklist(clean.typo_map(df)).collect()}
    assert rows == {0: "dog$1 concat dog$1好 c", 1: "名字"}
    assert [p for p in ["a+", "(x", "[y]"] if pattern(p)] == ["a+", "[y]"]


def test_dict_repair_skips_short_paragraphs(spark):
    assert one(spark, ["因该", "我们因该去图书管看一看书"], clean.dict_repair) == ["因该", "我们应该去图书馆看一看书"]


@pytest.mark.parametrize("text,want", [("皮皮鲁问。后续内容", True), ("小神马说。后续内容", True), ("比克答道。后续内容", True), ("皮皮鲁问小神马。后续内容", False), ("我自己来的。后续内容", False), ("从哪儿来？后续内容", False), ("", False)])
def test_attribution(text, want):
    assert segment.is_attribution(text) is want


def test_resegment_keeps_all_text(spark):
    text = ("他走进房间看了看四周的样子。" * 8 + "“你好。” 第二天他又来了。忽然下雨了。3天后雨停了。「好。」「不好。」一、开头的内容。") * 3
    parts = segment.split_sentences(text)
    assert "".join("".join(parts).split()) == "".join(text.split()) and len(parts) > 10
    df = spark.createDataFrame([(1, text), (2, "short"), (3, "")], "doc_id int, text string")
    rows = segment.resegment(df).orderBy("doc_id", "idx").collect()
    assert [r.text for r in rows if r.doc_id == 2] == ["short"] and len([r for r in rows if r.doc_id == 1]) > 3
    titled = {r.doc_id: r.text for r in segment.split_chapter_titles(spark.createDataFrame([(1, "前文◇ 四 ◇  正文第12章\n后文"), (2, "没有标题")], "doc_id int, text string")).collect()}
    assert titled == {1: "前文\n\n◇ 四 ◇\n\n正文\n\n第12章\n\n后文", 2: "没有标题"}


def test_resegment_has_all_documents_and_paragraphs(spark, tmp_path):
    long = "他走了看了。" * 100
    rows = [(0, None), (1, ""), (2, " \n　"), (3, "short"), (4, "第１２集 风起\n" + long), (5, "一行\n二行\r\n" + long + "\n四行"), (6, "他说「我说『好。』」" * 60)]
    query = registry.queries()["gen_resegment"]
    for folder, end in (("a", "x"), ("b", "y")):
        docs = spark.createDataFrame([(d, None if t is None else t + end) for d, t in rows], "doc_id long, text string")
        docs.selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source").write.parquet(f"{tmp_path}/{folder}/documents.parquet")
    a, b = ({r.doc_id: r for r in query(spark, f"{tmp_path}/{folder}").collect()} for folder in "ab")
    assert sorted(a) == sorted(b) == [0, 1, 2, 3, 4, 5, 6] and (a[0].n, a[0].chars, a[0].last) == (0, 0, None) and a[3].last == a[3].n - 1
    assert a[0] == b[0] and all(a[i] != b[i] and a[i].chars == b[i].chars for i in range(1, 7))
    got = segment.resegmented(spark.createDataFrame([*rows, (6, "again\n\ntwice")], "doc_id long, text string")).collect()
    said = ["\n".join(["他说「我说『好。』」"] * n) for n in [8] * 7 + [4]]
    assert sorted((r.doc_id, list(r.texts)) for r in got) == [(0, []), (1, []), (2, []), (3, ["short"]), (4, ["第１２集 风起", long]), (5, ["一行", "二行", long, "四行"]), (6, ["again", "twice"]), (6, said)]


def cut_by_character(text):
    """Titles and breaks looked for at each character in turn; the end mark's closing quotes go with it."""
    skip = lambda i: next((j for j in range(i, len(text)) if text[j] not in " \t"), len(text))
    marker = lambda i: text.startswith(tuple(segment.TIMES + segment.TOPICS), i) or re.match("[0-9]+个?(月|天|年|小时|分钟|星期|周)(以后|后|以前|前)", text[i:])

    def title_end(i):
        if text[i] == "◇" and "◇" in text[i + 1 : i + 20]:
            return text.index("◇", i + 1) + 1
        if not (text[i] == "第" and any(c.isdecimal() or c in "章节回" for c in text[i + 1 : i + 10]) or text[i] in "一二三四五六七八九十" and text[i + 1 : i + 2] == "、"):
            return i
        ends = (j for j in range(i, min(len(text), i + 50)) if text[j] == "\n" or j > i and text[j] == "◇" or j > i + 2 and text[j] in "。！？")
        return next(ends, min(i + 20, len(text)) - 1) + 1

    def break_end(i):
        after = skip(i + 1)
        if text[i] in "。！？" and after < len(text):
            if text[after] in "」』":
                while text[after : after + 1] in ("」", "』"):
                    last, after = after, skip(after + 1)
                return last + 1 if after < len(text) else None
            if marker(after) or text[after] in "\"'「『" and skip(after + 1) < len(text):
                return i + 1
        closed = text[i] in "」』" and i > 0 and text[i - 1] in "。！？…" and after < len(text)
        return i + 1 if closed and (text[after] in "\"'「『" or marker(after)) else None

    parts, now, i = [], "", 0
    while i < len(text):
        if (end := title_end(i)) > i:
            parts += [now, text[i:end]]
            now, i = "", end
        elif end := break_end(i):
            parts.append(now + text[i:end])
            now, i = "", end
        elif text[i] in "。！？" and text[i + 1 :].strip(" \t」』") == "":
            now, i = now + text[i:], len(text)
        else:
            now, i = now + text[i], i + 1
    return [p for p in (x.strip(fn.SPACES) for x in [*parts, now]) if p]


def test_cuts_equal_those_found_character_by_character():
    rng = random.Random(4)
    pieces = [*"。！？…」「』『\"' \t\n，x　１◇第章\x1f", "他走", "苏宁说。", "苏宁说，", "第二天", "忽然", "3天后", "10个月前", "2小时以后", "一、", "第5章", "第１２集"]
    for _ in range(20_000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 30)))
        assert segment.split_sentences(text) == cut_by_character(text), text


def test_merge_short(spark):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(["a" * 50, "b" * 50, "第一章", "c" * 100, "d"])], "doc_id int, idx int, text string")
    got = [r.text for r in segment.merge_short(df).orderBy("idx").collect()]
    assert got == ["a" * 50 + "\n" + "b" * 50, "第一章", "c" * 100, "d"]


def test_chunks_cover_and_merge_back(spark):
    text = "".join(f"第{i}句话在这里说了一些不同的内容编号{i * 7919 % 1009}。" + ("\n\n" if i % 9 == 0 else "") for i in range(900))
    df = spark.createDataFrame([(1, text), (2, "tiny"), (3, "x" * 2500), (4, "")], "doc_id int, text string")
    cut = segment.chunks(df, 1000, 100)
    for doc, t in ((1, text), (3, "x" * 2500)):
        spans = [(r.start, r.end) for r in cut.filter(f"doc_id = {doc}").orderBy("chunk_id").collect()]
        assert spans[0][0] == 0 and spans[-1][1] == len(t) and all(b[0] == a[1] - 100 for a, b in zip(spans, spans[1:]))
    back = {r.doc_id: r.text for r in segment.merge_chunks(cut).collect()}
    assert back[1] == text and back[2] == "tiny" and back[4] == ""


def test_diff():
    for a, b in (("hello world 12", "hello new world"), ("", "x"), ("x", ""), ("他说好", "他说不好"), ("a b c d", "d c b a")):
        ops = segment.diff_tokens(a, b)
        assert "".join(t for k, t in ops if k != "insert") == a and "".join(t for k, t in ops if k != "delete") == b
        assert all(p[0] != q[0] for p, q in zip(ops, ops[1:]))


def test_repair_checks(spark):
    cases = [("", "x", "empty"), ("他走了。", "。他走了", "moved_mark"), ("短文本", "短文本多", "short_changed"), ("a" * 30, "a" * 40, "length"), ("a" * 30, "b" * 30, "distance"), ("a" * 30, "a" * 29 + "b", "ok"), ("a" * 600, "b" * 600, "ok")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string")
    got = {r.i: r.v for r in df.select("i", review.repair_verdict(F.col("a"), F.col("b")).alias("v")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[2] for c in cases]


def test_apply_review_and_suggestions(spark):
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(["a", "b", "c", "d", "e"])], "doc_id int, idx int, text string")
    rows = [(1, 0, "a", "", "", "duplicate_paragraph", "approved"), (1, 1, "b", "B\n!", "", "llm_repair", "approved"), (1, 2, "c", "", "C?", "llm_repair", "edited"), (1, 3, "d", "D", "", "llm_repair", "rejected")]
    decided = spark.createDataFrame(rows, "doc_id int, idx int, original_text string, suggested_text string, edited_text string, kind string, status string")
    assert review.apply_review(lines, decided).first().text == "B!\nC?\nd\ne"
    docs = spark.createDataFrame([(1, "one two\n\nthree four\n\nthree four")], "doc_id int, text string")
    changes = spark.createDataFrame([(1, "duplicate_paragraph", "three fouR", "", 20), (1, "typo_correction", "two", "2", 5), (1, "rule", "o", "0", 1)], "doc_id int, kind string, original string, replacement string, position int")
    assert review.apply_suggestions(docs, changes).first().text == "0ne 2\n\nthree four"


def test_quota_and_health(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, i, t0 + dt.timedelta(seconds=s)) for i, s in enumerate([0, 1, 2, 3, 11, 12])] + [(2, 10, t0)]
    got = {r.event_id: r.allowed for r in health.quota(spark.createDataFrame(rows, "key long, event_id long, ts timestamp_ntz"), 2, 10).collect()}
    assert [got[i] for i in range(6)] == [True, True, False, False, True, True] and got[10]
    checks = [(1, i, t0 + dt.timedelta(seconds=i), ok, ms) for i, (ok, ms) in enumerate([(True, 100), (True, 200), (False, 5), (False, 5), (True, 0)])]
    df = spark.createDataFrame(checks, "service long, event_id long, ts timestamp_ntz, healthy boolean, duration_ms long")
    got = [tuple(r)[2:] for r in health.health_ema(df).orderBy("event_id").collect()]
    assert got == [(100, 0, False, True), (110, 0, False, True), (110, 1, True, True), (110, 2, False, True), (99, 0, True, True)]
    runs = health.health_runs(df).orderBy("event_id").collect()
    assert [(r.errors, r.flipped) for r in runs] == [(0, False), (0, False), (1, True), (2, False), (0, True)]


def test_names_and_similarity(spark):
    got = values(spark, ["张三-书名.txt", "a very long author-title.txt", "plain.txt", "-x.txt", "书名·张三.tar.gz"], fn.parse_filename)
    assert [(r.author, r.title) for r in got] == [("张三", "书名"), ("title", "a very long author"), ("", "plain"), ("", "-x"), ("书名", "张三.tar")]
    sim = values(spark, ["abcd", "", "abXd1"], lambda t: fn.positional_similarity(t, F.lit("abcd")))
    assert sim == [1.0, 0.0, 0.6]
    vec = values(spark, ["你好，世界！", ""], fn.local_vector)
    assert all(len(v) == 32 and all(0 <= x <= 1 and not math.isnan(x) for x in v) for v in vec)


def test_enqueue_caps_at_an_hour(spark):
    df = spark.createDataFrame([(1, 0, 0), (1, 1, 3), (1, 2, 9)], "file_id int, chunk_id int, retry_count int")
    got = [r.next_retry_at for r in catalog.enqueue(df, "2024-01-01 00:00:00").orderBy("chunk_id").collect()]
    assert [(g - dt.datetime(2024, 1, 1)).total_seconds() / 60 for g in got] == [1, 8, 60]


@pytest.mark.parametrize("window,stretch,nearest", [(300, 4096, False), (7, 16, False), (7, 7, True), (0, 16, False), (0, 5, True), (90, 16, True)])
def test_near_duplicates_equal_brute_force(spark, window, stretch, nearest):
    rng = np.random.default_rng(window)
    rows = []
    for file in ("a", "b", None):
        for i in range(60):
            vec = [float(c) for c in rng.integers(-1, 2, 3)]
            rows.append((file, i * 3 if file == "b" else i, vec if i % 9 else [None, [], [0.0, 0.0, 0.0], [1.0, 1.0], [1e200, 1e200, 0.0], [1e-200, 0.0, 0.0]][i // 9 % 6]))

    def cos(a, b):
        a, b = (np.array(v) / max(np.abs(v), default=1) if any(v) else np.array(v) for v in (a, b))
        return float(a @ b / np.sqrt((a @ a) * (b @ b))) if len(a) == len(b) and len(a) and (a @ a) * (b @ b) > 0 else 0.0

    want = {}
    for f, i, v in rows:
        for g, j, u in rows:
            if f == g and f and v is not None and u is not None and j < i and (not window or i - j <= window) and cos(v, u) >= 0.7:
                want[f, i, j] = cos(v, u)
    found = dedup.near_duplicates(spark.createDataFrame(rows, "file_id string, idx int, vec array<double>"), window, 0.7, nearest, stretch).collect()
    got = {(r.file_id, r.i, r.j): r.sim for r in found}
    assert len(got) == len(found)
    if nearest:
        best = lambda pairs: {(f, i): max(j for g, k, j in pairs if (g, k) == (f, i)) for f, i, _ in pairs}
        assert best(got) == best(want) and set(got) <= set(want)
    else:
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want) and len(want) > 20


def longest_common(x, y):
    t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, a in enumerate(x):
        for j, b in enumerate(y):
            t[i + 1][j + 1] = t[i][j] + 1 if a == b else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_diffs_are_shortest():
    rng = random.Random(1)
    text = lambda: [rng.choice("abc12") for _ in range(rng.randint(0, 16))]
    for _ in range(500):
        x, y = text(), text()
        steps = list(segment.edit_steps(x, y))
        assert [t for k, ts in steps if k != "insert" for t in ts] == x and [t for k, ts in steps if k != "delete" for t in ts] == y
        assert sum(len(ts) for k, ts in steps if k == "equal") == longest_common(x, y)


def test_long_diffs_in_bounded_space():
    rng = random.Random(2)
    x = [str(rng.randrange(2000)) for _ in range(6000)]
    y = [t if rng.random() < 0.8 else "new" for t in x] + [str(i) for i in range(10**6, 10**6 + 20_000)]
    tracemalloc.start()
    steps = list(segment.edit_steps(x, y))
    assert tracemalloc.get_traced_memory()[1] < 50 << 20  # a table of both sides would have 1.6e8 cells
    tracemalloc.stop()
    assert sum(len(ts) for k, ts in steps if k == "equal") == sum(a == b for a, b in zip(x, y))


def test_small_files_are_compared_together(spark):
    """Files of a few rows share a matrix product: 4,000 of them take about what one file of as many rows does."""
    rng = np.random.default_rng(4)
    vecs = rng.normal(size=(12_000, 8)).tolist()

    def table(size):
        rows = pa.table({"file_id": np.arange(12_000) // size, "part": np.zeros(12_000, np.int64), "idx": np.arange(12_000) % size, "later": [True] * 12_000, "earlier": [True] * 12_000, "vec": vecs})
        return rows, np.arange(12_000) // size

    def least(size, window, nearest):
        taken = []
        for _ in range(3):
            before = time.process_time()
            found = dedup._alike(*table(size), window, 0.9, nearest)
            taken.append(time.process_time() - before)
        return min(taken), sorted((int(a), int(b)) for i, j, _ in found for a, b in zip(i, j))

    unit = np.array(vecs) / np.linalg.norm(vecs, axis=1)[:, None]
    want = sorted((i, j) for i in range(12_000) for j in range(i - i % 3, i) if unit[i] @ unit[j] >= 0.9)
    for window in (0, 1, 300):
        few = [(i, j) for i, j in want if not window or i - j <= window]
        taken, found = least(3, window, False)
        assert few and found == few
        assert [i for i, _ in least(3, window, True)[1]] == sorted({i for i, _ in few})
        assert taken < 3 * least(12_000, 300, False)[0] + 0.5


def test_marks_and_trim_of_named_texts(spark):
    """What meets neither the regex nor `translate` is as if it had."""
    rng = random.Random(6)
    chars = [*fn.SPACES, *fn.MARKS, *"abé他𠀀\x00\x1c\u180e\u200b\ufeff\u2013\uff5f"]
    texts = [None, "", *("".join(rng.choice(chars) for _ in range(rng.randint(0, 6))) for _ in range(500)), *chars]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", fn.utrim(F.col("t")).alias("a"), fn.utrim_named(F.col("t")).alias("b"), F.translate("t", fn.MARKS, "").alias("c"), fn.without_marks(F.col("t")).alias("d")).collect()
    assert all(r.a == r.b and r.c == r.d for r in got) and any(r.a != r.t for r in got) and any(r.c != r.t for r in got)


def test_pairs_are_compared_at_once():
    """Many pairs at once give what each gives alone; whole words are one token, all else is as the token pattern has it."""
    rng = random.Random(3)
    token = re.compile(r"[一-鿿㐀-䶿豈-﫿]|[a-zA-Z]+|[0-9]+|\s+|.", re.DOTALL)
    text = lambda: "".join(rng.choice([*"ab1 \n\t他é!。𠀀\x1c\u3000\x85", "the", "THE", "12"]) for _ in range(rng.randint(0, 20)))
    pairs = [(t, t.replace("the", "THE!") if i % 2 else text()) for i, t in enumerate(text() for _ in range(600))] + [("", ""), ("", "x y"), ("x y", "")]
    got = segment.diffs(*map(list, zip(*pairs))).to_pylist()
    for (a, b), ops in zip(pairs, got):
        want: list[list] = []
        for kind, tokens in segment.edit_steps(token.findall(a), token.findall(b)):
            if tokens and want and want[-1][0] == kind:
                want[-1][1] += "".join(tokens)
            elif tokens:
                want.append([kind, "".join(tokens)])
        assert [[o["type"], o["value"]] for o in ops] == want and segment.diff_tokens(a, b) == [tuple(w) for w in want]
    assert segment.diffs([], []).to_pylist() == []


def test_a_diff_takes_less_than_two_passes_of_a_token_pattern():
    """Tokens are places in one array, so cutting, numbering and comparing them takes no step a token."""
    token = re.compile(r"[一-鿿㐀-䶿豈-﫿]|[a-zA-Z]+|[0-9]+|\s+|.", re.DOTALL)
    a = ["the word, 12 " * 600] * 100
    b = [t.replace("the", "THE!") for t in a]

    def least(job):
        taken = []
        for _ in range(3):
            before = time.process_time()
            job()
            taken.append(time.process_time() - before)
        return min(taken)

    assert least(lambda: segment.diffs(a, b)) < 1.5 * least(lambda: [token.findall(t) for t in a + b])


def test_diff_rows_keep_their_keys(spark):
    rows = [(5, 0, "a the b", "a THE! b"), (5, 3, None, "x"), (None, 1, "y", None), (6, 2, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, idx int, original_text string, suggested_text string")
    got = {(r.doc_id, r.idx): [(o.type, o.value) for o in r.ops] for r in segment.paragraph_diff(df).collect()}
    assert got == {(5, 0): [("equal", "a "), ("delete", "the"), ("insert", "THE!"), ("equal", " b")], (5, 3): [("insert", "x")], (None, 1): [("delete", "y")], (6, 2): []}


def test_headings_get_blank_lines_and_nothing_is_lost(spark):
    texts = ["a\x01b\x02c", "第一章第二章x", "x◇a◇", "x\n第1章\ny", "Chapter 3", "", None, "\x02第一章\x01"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: (r.text, r.n_chapters) for r in clean.post_chapters(df).collect()}
    assert [got[i][0] for i in range(8)] == ["a\x01b\x02c", "第一章\n\n第二章\n\nx", "x\n\n◇a◇", "x\n第1章\ny", "Chapter 3", "", None, "\x02\n\n第一章\n\n\x01"]
    assert [got[i][1] for i in (0, 1, 4)] == [0, 2, 1]
