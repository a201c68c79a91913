"""Cleaning jobs: each takes documents with a text column and gives them back with it cleaned, and counts beside it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quire.functions.patterns import pattern, replacement
from quire.functions.text import utrim

# Entities and what they stand for; `&amp;` comes last so that nothing is decoded twice.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#160;": " ", "&#8203;": "", "&#8204;": "", "&#8205;": "", "&amp;": "&"}
# Half-width marks and their full-width forms.
HALF, FULL = ",.:;?!()[]", "，。：；？！（）【】"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
# Traditional characters and their simplified forms, pair by pair.
TRADITIONAL = (
    "臺灣國體會學電腦網絡開關東西南北經濟動靜書畫長門時間說話見視聽覺點線麵機龍馬魚鳥熱愛後從來這個們嗎為過發現進問對頭實義務"
    "處總親結無裡當讓還應該氣車軍辦強戰師醫藥護衛員費買賣貨質詞語識評試證認誤誌記許論設計變達遠運連選遺陳陸隊階隻雙難雲須項順"
    "預頑頓頻題額顏風飛飯飲飼館駐駕騎驅驗髮鬥鬱鮮麗麥黃黨齊齣"
)
SIMPLIFIED = (
    "台湾国体会学电脑网络开关东西南北经济动静书画长门时间说话见视听觉点线面机龙马鱼鸟热爱后从来这个们吗为过发现进问对头实义务"
    "处总亲结无里当让还应该气车军办强战师医药护卫员费买卖货质词语识评试证认误志记许论设计变达远运连选遗陈陆队阶只双难云须项顺"
    "预顽顿频题额颜风飞饭饮饲馆驻驾骑驱验发斗郁鲜丽麦黄党齐出"
)
# Advertisement patterns of the basic pass, in order.
ADS = (
    '关注微信公众号["]?[^"\\n]*["]?获取更多免费小说[！!]?',
    "关注[^\\n]{0,20}公众号[^\\n]*",
    "本文由[^\\n]{2,30}提供[^\\n]*",
    "更多精彩内容请访问[^\\n]*",
    "下载[^\\n]{0,10}APP[^\\n]*",
    "www\\.[a-zA-Z0-9]+\\.[a-zA-Z]{2,}[^\\t\\n\\f\\r ]*",
    "https?://[^\\t\\n\\f\\r ]+",
    "欢迎加入[^\\n]{0,20}(?:群|频道|社区)[^\\n]*",
    "QQ群[:：][0-9]+[^\\n]*",
    "本章未完[，,]点击下一页继续[^\\n]*",
    "天才一秒记住[^\\n]*",
    "手机用户请浏览[^\\n]*",
)
# Advertisement patterns of the earlier pass, in order.
ADS_PRE = ("本文由[^\\n]*提供", "更多精彩内容请访问[^\\n]*", "下载APP[^\\n]*", "www\\.[a-zA-Z0-9]+\\.[a-zA-Z]{2,}", "https?://[^\\t\\n\\f\\r ]+")
# Garbled runs, and the marker left for them.
GARBLED = ("\\x{FFFD}{2,}", "(?:锟斤拷)+", "(?:烫烫烫)+", "(?:屯屯屯)+")
MARKER = ("[因无法修复的乱码删除了", "个字符]")
# Common typos, in order, and the least length of a paragraph that is repaired.
TYPOS = (("图书管", "图书馆"), ("及了", "极了"), ("在次", "再次"), ("哪么", "那么"), ("因该", "应该"), ("以经", "已经"), ("好象", "好像"), ("做车", "坐车"))
REPAIR_LENGTH = 10
# How chapters are headed.
CHAPTERS = "第[一二三四五六七八九十百千]+章|第[0-9]+章|Chapter [0-9]+|章节 [0-9]+|◇[^◇]+◇"


def replaced(df: DataFrame, steps: list[tuple[str, str]], literal: bool = False, text: str = "text", count: str | None = None) -> DataFrame:
    """Replaces in order, and counts all hits in the column `count`."""
    total = F.lit(0).cast("long")
    if count:
        df = df.withColumn(count, total)
    for what, by in steps:
        if count and literal:
            hits = ((F.char_length(text) - F.char_length(F.replace(F.col(text), F.lit(what), F.lit("")))) / len(what)).cast("long")
        elif count:
            hits = F.regexp_count(F.col(text), F.lit(what)).cast("long")
        if count:
            df = df.withColumn(count, F.col(count) + hits)
        df = df.withColumn(text, F.replace(F.col(text), F.lit(what), F.lit(by)) if literal else F.regexp_replace(F.col(text), what, by))
    return df


def html_entities(docs: DataFrame) -> DataFrame:
    return replaced(docs, list(ENTITIES.items()), literal=True, count="n")


#: A half-width mark with a Han character up to three before or up to two after it; the look-behind starts at a mark only.
NEAR_HAN = r"[,.:;?!()\[\]](?:(?<=\p{IsHan}[\s\S]{1,3})|(?=[\s\S]{0,1}\p{IsHan}))"
#: Noncharacters that flag such marks, so that plain replacements widen them; a text that holds one is flagged by the other.
FLAGS = ("\uFDD0", "\uFDD1")


def cjk_punct(docs: DataFrame) -> DataFrame:
    """Half-width marks become full-width where a Han character stands up to three before or up to two after. n counts them."""
    flag = F.when(F.contains("text", F.lit(FLAGS[0])), FLAGS[1]).otherwise(FLAGS[0])
    flagged = docs.withColumn("flag_", flag).withColumn("flagged_", F.regexp_replace(F.col("text"), F.lit(NEAR_HAN), F.concat("flag_", F.lit("$0"))))
    text = F.col("flagged_")
    for half, full in zip(HALF, FULL):
        text = F.replace(text, F.concat("flag_", F.lit(half)), F.lit(full))
    return flagged.withColumn("n", (F.char_length("flagged_") - F.char_length("text")).cast("long")).withColumn("text", text).drop("flag_", "flagged_")


def control_chars(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text", F.regexp_replace("text", CONTROL, ""))


def whitespace_basic(docs: DataFrame) -> DataFrame:
    """Control characters out, line ends LF, at most one blank line, lines right-trimmed, single spaces, trimmed."""
    ends = replaced(control_chars(docs), [("\r\n", "\n"), ("\r", "\n")], literal=True)
    marked = ends.withColumn("n_blank", F.col("text").rlike("\n{3,}").cast("long"))
    return replaced(marked, [("\n{3,}", "\n\n"), ("[ \t]+(?=\n|\\z)", ""), ("[ \t]{2,}", " ")]).withColumn("text", utrim(F.col("text")))


def whitespace_pre(docs: DataFrame) -> DataFrame:
    """Runs of horizontal space (CR too) become one, one space beside LF goes, at most one blank line, trimmed."""
    return replaced(replaced(replaced(docs, [("[ \t\f\r]+", " ")]), [(" \n", "\n"), ("\n ", "\n")], literal=True), [("\n{3,}", "\n\n")]).withColumn("text", utrim(F.col("text")))


def trad_to_simp(docs: DataFrame) -> DataFrame:
    n = F.char_length("text") - F.char_length(F.translate("text", TRADITIONAL, ""))
    return docs.withColumn("n", n.cast("long")).withColumn("text", F.translate("text", TRADITIONAL, SIMPLIFIED))


def ads_basic(docs: DataFrame) -> DataFrame:
    return replaced(docs, [(p, "") for p in ADS], count="n")


def ads_pre(docs: DataFrame) -> DataFrame:
    return replaced(docs, [(p, "") for p in ADS_PRE], count="n")


def garbled(docs: DataFrame) -> DataFrame:
    """Garbled runs become a marker with their length; n_runs and n_chars say how much that was."""
    df = docs.withColumn("n_runs", F.lit(0).cast("long")).withColumn("n_chars", F.lit(0).cast("long"))
    for pattern in GARBLED:
        runs = F.regexp_extract_all(F.col("text"), F.lit(pattern), F.lit(0))
        marked = F.zip_with(F.split("text", pattern), "runs_", lambda t, r: F.concat(t, F.when(r.isNull(), "").otherwise(F.concat(F.lit(MARKER[0]), F.char_length(r).cast("string"), F.lit(MARKER[1])))))
        df = (
            df.withColumn("runs_", runs)
            .withColumn("n_runs", F.col("n_runs") + F.size("runs_"))
            .withColumn("n_chars", F.col("n_chars") + F.aggregate("runs_", F.lit(0).cast("long"), lambda acc, r: acc + F.char_length(r)))
            .withColumn("text", F.when(F.size("runs_") > 0, F.array_join(marked, "")).otherwise(F.col("text")))
        )
    return df.drop("runs_")


@F.pandas_udf(ArrayType(StringType()))
def translated(patterns: pd.Series) -> pd.Series:
    """A row's patterns as Java's, in order; those that RE2 refuses, and empty ones, are left out. Lists repeat, so each is looked at once."""
    seen: dict[tuple, list[str]] = {}

    def one(ps) -> list[str]:
        key = tuple(ps) if ps is not None else ()
        if key not in seen:
            seen[key] = [found.java for p in key if p and (found := pattern(p)) is not None]
        return seen[key]

    return patterns.map(one)


def ad_blacklist(docs: DataFrame, patterns: str = "ad_blacklist") -> DataFrame:
    """Removes each row's own patterns (an array column, RE2 dialect) in order; those that are none are skipped."""
    return without(docs.withColumn("patterns_", translated(F.col(patterns))), "patterns_").drop("patterns_")


def without(docs: DataFrame, patterns: str) -> DataFrame:
    """Removes each row's own patterns, as `translated` gives them, in order."""
    return docs.withColumn("text", F.aggregate(patterns, F.col("text"), lambda t, p: F.regexp_replace(t, p, F.lit(""))))


def typo_map(docs: DataFrame, typos: str = "typo_map") -> DataFrame:
    """Replaces each row's own wrong -> right pairs, by key order; a key with ASCII characters matches whole words only."""
    quoted = lambda k: F.regexp_replace(k, r"([\\\[\]{}()^$.|?*+\-&~#\s])", r"\\$1")

    def step(text: Column, e: Column) -> Column:
        whole = F.regexp_replace(text, F.concat(F.lit("(?<![0-9A-Za-z_])"), quoted(e["key"]), F.lit("(?![0-9A-Za-z_])")), F.regexp_replace(e["value"], r"([\\$])", r"\\$1"))
        return F.when(e["key"].rlike("[\\x00-\\x7F]"), whole).otherwise(F.replace(text, e["key"], e["value"]))

    return docs.withColumn("text", F.aggregate(F.array_sort(F.map_entries(typos)), F.col("text"), step))


def apply_rules(docs: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Global regex rules (pattern, replacement; RE2 dialect) in order; those that are none are skipped. `changed` says whether any did something."""
    before = docs.withColumn("before_", F.col("text"))
    steps = [(found.java, replacement(by, found)) for p, by in rules if (found := pattern(p)) is not None]
    return replaced(before, steps).withColumn("changed", F.col("text") != F.col("before_")).drop("before_")


def dict_repair(paragraphs: DataFrame) -> DataFrame:
    """Common typos, each occurrence one change; short paragraphs stay as they are."""
    fixed = replaced(paragraphs.withColumn("before_", F.col("text")), list(TYPOS), literal=True, count="n")
    long = F.char_length("before_") >= REPAIR_LENGTH
    return fixed.withColumn("n", F.when(long, F.col("n")).otherwise(F.lit(0)).cast("long")).withColumn("text", F.when(long, F.col("text")).otherwise(F.col("before_"))).drop("before_")


def sanitize_paragraph(text: Column) -> Column:
    return F.regexp_replace(text, "[\r\n]", "")


def post_format(docs: DataFrame) -> DataFrame:
    return replaced(docs, [("\n{3,}", "\n\n")]).withColumn("text", utrim(F.col("text")))


def post_chapters(docs: DataFrame) -> DataFrame:
    """A blank line before and after each chapter heading, unless a line end is there; counts headings.

    The text is cut at its headings. Where a part is empty, two headings touch, and one blank line goes between them.
    """
    cut = docs.withColumn("heads_", F.regexp_extract_all(F.col("text"), F.lit(CHAPTERS), F.lit(0))).withColumn("parts_", F.split("text", CHAPTERS, -1))
    blank = F.lit("\n\n")

    def spaced(part: Column, i: Column) -> Column:
        head = F.get("heads_", i)
        after = F.when((i > 0) & (part != "") & ~part.startswith("\n"), blank).otherwise("")
        before = F.when(F.when(part == "", i > 0).otherwise(~part.endswith("\n")), blank).otherwise("")
        return F.concat(after, part, F.when(head.isNull(), "").otherwise(F.concat(before, head)))

    text = F.when(F.size("heads_") > 0, F.array_join(F.transform("parts_", spaced), "")).otherwise(F.col("text"))
    return cut.withColumn("n_chapters", F.size("heads_").cast("long")).withColumn("text", text).drop("heads_", "parts_")


def post_punct(docs: DataFrame) -> DataFrame:
    """All half-width marks become full-width (a full stop unless a digit touches it), and repeats collapse."""
    wide = docs.withColumn("text", F.translate("text", ",:;?!", "，：；？！"))
    return replaced(wide, [("(?<![0-9])\\.(?![0-9])", "。"), ("([，。：；？！])\\1+", "$1")])


def preprocess(docs: DataFrame) -> DataFrame:
    """Garbled runs, control characters, the earlier advertisement pass, horizontal space."""
    return whitespace_pre(ads_pre(control_chars(garbled(docs).drop("n_runs", "n_chars"))).drop("n"))


def basic_clean(docs: DataFrame, simplify: bool | Column = True) -> DataFrame:
    """Entities, punctuation by context, white space, simplification (where `simplify` holds), advertisements."""
    spaced = whitespace_basic(cjk_punct(html_entities(docs).drop("n")).drop("n")).drop("n_blank")
    if isinstance(simplify, Column):
        simple = spaced.withColumn("text", F.when(simplify, F.translate("text", TRADITIONAL, SIMPLIFIED)).otherwise(F.col("text")))
    else:
        simple = trad_to_simp(spaced).drop("n") if simplify else spaced
    return ads_basic(simple).drop("n")


def changes(docs: DataFrame) -> DataFrame:
    """One row per document, kind of change and stage with its number; kinds without a change are left out. One pass over the texts."""
    found = [("entities", html_entities, "n", "basic"), ("punctuation", cjk_punct, "n", "basic"), ("blank_lines", whitespace_basic, "n_blank", "basic"), ("traditional", trad_to_simp, "n", "basic"), ("advertisement", ads_basic, "n", "basic"), ("garbled", garbled, "n_runs", "pre")]
    df = docs.select("doc_id", F.col("text").alias("whole_"))
    for kind, job, n, _ in found:
        keep = [c for c in df.columns if c != "text"]
        df = job(df.withColumn("text", F.col("whole_"))).select(*keep, F.col(n).alias(f"n_{kind}"))
    rows = F.array(*[F.struct(F.lit(stage).alias("stage"), F.lit(kind).alias("kind"), F.col(f"n_{kind}").alias("n")) for kind, _, _, stage in found])
    return df.select("doc_id", F.explode(rows).alias("c")).select("doc_id", "c.*").filter("n > 0")
