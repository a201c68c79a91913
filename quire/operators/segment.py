"""Paragraphs, lines, re-segmentation, chunks and paragraph differences."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quire.functions.text import SPACES, utrim, utrim_named

# Least length of a paragraph that stands alone, chunk size, overlap, and how far back a cut is looked for.
MIN_PARAGRAPH, CHUNK, OVERLAP, LOOK_BACK = 80, 8000, 200, 400
# Words that open a new paragraph by time or by topic.
TIMES = (
    "第二天 第三天 几天后 几天以后 几天过去了 几个月后 几个月以后 一年后 几年后 多年以后 多年后 那年 这天 那天 当天 每天 后来 此刻 此时 这时 那时 "
    "一会儿 过了 不久 随即 随后 紧接着 终于 最终 最后 从此 从那以后 从今以后 打那以后 转眼间 一晃 不知不觉 早晨 中午 下午 傍晚 晚上 深夜 半夜 凌晨 清晨"
).split()
TOPICS = (
    "就这样 于是 可是 然而 但是 不过 忽然 突然 没想到 谁知 果然 原来 其实 毕竟 当然 再说 另外 此外 事实上 且说 却说 话虽如此 外面 另一边 与此同时 当晚 次日 翌日 从这天起 打这天起"
).split()
UNITS, AFTER = "月|天|年|小时|分钟|星期|周", "以后|后|以前|前"
SAYING = "说问喊叫道答骂笑哭吼叹嚷"
TITLE = r"^(?:◇[\s\S]*◇|第[\s\S]*[章节回]|[一二三四五六七八九十]、[\s\S]*)$"


# ---------------------------------------------------------------- columns


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, idx, text): non-empty trimmed lines, numbered from 0."""
    return docs.select("doc_id", F.posexplode(_paragraph_list(F.col("text"))).alias("idx", "text"))


def _paragraph_list(text: Column) -> Column:
    lines = F.transform(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n"), utrim_named)
    return F.filter(lines, lambda x: x != "")


def baseline_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, idx, text): all lines, empty ones too."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "text"))


def is_chapter_title(text: Column) -> Column:
    return utrim(text).rlike(TITLE)


def needs_resegmentation(text: Column) -> Column:
    """At least 100 bytes, a Chinese end mark, and no line end, over 300 characters for each, or a trimmed line over 500."""
    ends = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))
    sparse = (ends == 0) | (F.floor(F.char_length(text) / F.greatest(ends, F.lit(1))) > 300)
    long = F.exists(F.split(text, "\n"), lambda x: F.char_length(utrim(x)) > 500)
    return (F.octet_length(text) >= 100) & text.rlike("[。」』？！]") & (sparse | long)


def merge_short(parts: DataFrame, least: int = MIN_PARAGRAPH) -> DataFrame:
    """(doc_id, idx, text) -> the same: a short paragraph takes the next ones in, up to `least` characters or a title.

    A document's paragraphs are folded in order; they are bounded by one document.
    """

    def step(acc: Column, text: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        joins = (F.size(acc) > 0) & (F.char_length(last) < least) & ~is_chapter_title(last) & ~is_chapter_title(text)
        return F.when(joins, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(last, F.lit("\n"), text)))).otherwise(F.concat(acc, F.array(text)))

    texts = F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda p: p["text"])
    folded = parts.groupBy("doc_id").agg(texts.alias("texts")).select("doc_id", F.aggregate("texts", F.expr("cast(array() as array<string>)"), step).alias("texts"))
    return folded.select("doc_id", F.posexplode("texts").alias("idx", "text"))


def join_paragraphs(parts: DataFrame, between: str = "\n") -> DataFrame:
    """(doc_id, idx, text) -> (doc_id, text), in order of idx."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda p: p["text"])
    return parts.groupBy("doc_id").agg(F.array_join(texts, between).alias("text"))


def merge_chunks(chunks: DataFrame, most: int = 600, least: int = 20) -> DataFrame:
    """(doc_id, chunk_id, text) -> (doc_id, text): what a chunk and the next one share is kept once.

    With start and end, and texts as long as these say, that is the shared span if both texts agree on it. Else (rewritten
    chunks) it is the longest end of a chunk that begins the next one; without any, LF joins them.
    """
    w = W.partitionBy("doc_id").orderBy("chunk_id")
    fits = lambda n: (n <= F.char_length("before")) & (n <= F.char_length("text")) & (F.right("before", n) == F.left("text", n))
    lapped = chunks.withColumn("before", F.lag("text").over(w))
    n = F.get(F.filter(F.sequence(F.lit(most), F.lit(least), F.lit(-1)), fits), F.lit(0))
    if {"start", "end"} <= set(chunks.columns):
        lapped = lapped.withColumn("shared", F.lag("end").over(w) - F.col("start")).withColumn("as_cut", F.char_length("text") == F.col("end") - F.col("start"))
        lapped = lapped.withColumn("as_cut", F.col("as_cut") & F.lag("as_cut").over(w) & (F.col("shared") >= 0))
        n = F.when(F.col("as_cut") & fits(F.col("shared")), F.col("shared")).otherwise(n)
    part = F.when(F.col("before").isNull(), F.col("text")).when(n.isNotNull(), F.substr("text", n + 1)).otherwise(F.concat(F.lit("\n"), F.col("text")))
    return join_paragraphs(lapped.select("doc_id", F.col("chunk_id").alias("idx"), part.alias("text")), "")


# ---------------------------------------------------------------- scanners (Python tasks over gated rows)

_NEXT = "|".join(map(re.escape, sorted(TIMES + TOPICS, key=len, reverse=True))) + rf"|[0-9]+个?(?:{UNITS})(?:{AFTER})"
#: Where a title starts, or a stretch of text ends. All is looked up in the whole text, so that a title can be what follows a mark.
_CUT = re.compile(
    r"(?P<framed>◇[^◇]{0,18}◇)|(?P<headed>第(?=[\s\S]{0,8}[\d章节回])|[一二三四五六七八九十](?=、))"
    r"|[。！？](?:[ \t]*[」』])+(?=[ \t]*[^ \t」』])"  # speech that is closed
    r"|(?<=[。！？…])[」』](?=[ \t]*(?:[\"'「『]|" + _NEXT + "))"
    r"|[。！？](?=[ \t]*[\"'「『][ \t]*[^ \t])"  # speech that opens
    r"|[。！？](?=[ \t]*(?:" + _NEXT + "))"
)
_TITLE_END = re.compile(r"[\n◇。！？]")
_ATTRIBUTION = re.compile(rf"[^，。！？\"{SAYING}]{{0,3}}[{SAYING}]{{1,2}}[。！？]")


def is_attribution(text: str) -> bool:
    """Whether the text starts with who says it and a full stop: a name of up to three characters and a verb of saying."""
    return bool(_ATTRIBUTION.match(text))


def _title_end(text: str, start: int) -> int:
    for m in _TITLE_END.finditer(text, start + 1, start + 50):
        if m.group() in "\n◇" or m.start() > start + 2:
            return m.end()
    return min(len(text), start + 20)


def split_sentences(text: str) -> list[str]:
    """Titles by themselves, and the text between them cut at its breaks; trimmed, empty parts dropped."""
    parts, at = [], 0
    while m := _CUT.search(text, at):
        start, end = m.span()
        if m.lastgroup:
            parts.append(text[at:start])
            at = start
        if m.lastgroup == "headed":
            end = _title_end(text, start)
        parts.append(text[at:end])
        at = end
    parts.append(text[at:])
    return [p for p in (x.strip(SPACES) for x in parts) if p]


@F.pandas_udf(ArrayType(StringType()))
def _cut_anew(texts: pd.Series) -> pd.Series:
    """The paragraphs of texts that need it; null for null, and where no more than one comes out."""

    def one(text: str | None) -> list[str] | None:
        found = _short_merged(split_sentences(text), MIN_PARAGRAPH) if text is not None else []
        return found if len(found) > 1 else None

    return texts.map(one)


def resegmented(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, texts), a row for each document: those that need it are cut anew and short parts merged; others, and those
    in which there is nothing to cut, keep their paragraphs. Without text there are none. Only texts that need it go to Python."""
    dense = F.when(needs_resegmentation(F.col("text")), F.col("text"))
    return docs.select("doc_id", F.coalesce(_cut_anew(dense), _paragraph_list(F.col("text")), F.expr("cast(array() as array<string>)")).alias("texts"))


def resegment(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, idx, text): the paragraphs of `resegmented`, numbered from 0."""
    return resegmented(docs).select("doc_id", F.posexplode("texts").alias("idx", "text"))


def spaced_titles(text: str) -> str:
    """Chapter titles (marks around them, a number, or a numeral and a comma) between blank lines."""
    pattern = re.compile(r"◇[^◇]{0,18}◇|第[0-9]{0,8}[章节回]|[一二三四五六七八九十]、(?:[^\n]{0,27}(?=\n)|[^\n。！？]{0,27}[。！？])")
    if len(text) < 5:
        return text
    out = ""
    at = 0
    for m in pattern.finditer(text):
        before = text[at : m.start()] if m.start() >= at else ""
        if out:
            before = before.lstrip(" \t\n\r")
            out += ("\n\n" + before) if before else ""
        else:
            out += before
        out += ("" if not out or out.endswith("\n\n") else "\n" if out.endswith("\n") else "\n\n") + m.group()
        at = m.end()
    rest = text[at:]
    if at and out:
        rest = rest.lstrip(" \t\n\r")
        return out + ("\n\n" + rest if rest else "")
    return out + rest


def split_chapter_titles(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with titles between blank lines; texts without a title mark never leave the JVM."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(text=[spaced_titles(t) for t in frame.text])

    marked = F.coalesce(F.col("text").rlike("◇|第|[一二三四五六七八九十]、"), F.lit(False))
    rows = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.filter(marked).mapInPandas(scan, f"doc_id {kind}, text string").unionByName(rows.filter(~marked))


def _short_merged(parts: list[str], least: int) -> list[str]:
    """merge_short for one document's parts."""
    title = re.compile(TITLE)
    out: list[str] = []
    for text in parts:
        if out and len(out[-1]) < least and not title.search(out[-1].strip(SPACES)) and not title.search(text.strip(SPACES)):
            out[-1] += "\n" + text
        else:
            out.append(text)
    return out


def newlines_fixed(docs: DataFrame, keep: tuple[Column, Column] | None = None) -> DataFrame:
    """(doc_id, text) -> the same: documents that need it get paragraphs between blank lines, then titles stand apart.

    keep: a condition, and the text that stays as it is where it holds. One task does both, row by row, so that what made
    the text is computed once and no row goes another way round.
    """

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            cut = ["\n\n".join(_short_merged(split_sentences(t), MIN_PARAGRAPH)) if g else t for t, g in zip(frame.text, frame.gate)]
            yield frame[["doc_id"]].assign(text=[t if k or not t else spaced_titles(t) for t, k in zip(cut, frame.kept)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    kept = F.coalesce(keep[0], F.lit(False)) if keep else F.lit(False)
    gate = ~kept & F.coalesce(needs_resegmentation(F.col("text")), F.lit(False))
    text = F.when(kept, keep[1]).otherwise(F.col("text")) if keep else F.col("text")
    return docs.select("doc_id", text.alias("text"), gate.alias("gate"), kept.alias("kept")).mapInPandas(scan, f"doc_id {kind}, text string")


def cut_point(text: str, start: int, end: int) -> int:
    """Where a chunk that may reach `end` ends: after a blank line, an end mark with a quote, an end mark, a quote, a line end, else at end."""
    low = max(start, end - LOOK_BACK)
    blank = text.rfind("\n\n", max(0, low - 1), end + 1)
    if blank >= 0:
        return blank + 2
    marks, quotes = "。！？", '"」』'
    both = max((text.rfind(m + q, low, end) for m in marks for q in quotes), default=-1)
    if both >= 0:
        return both + 2
    mark = max(text.rfind(m, low, end) for m in marks)
    if mark >= 0:
        return mark + (2 if text[mark + 1 : mark + 2] and text[mark + 1] in quotes else 1)
    last = max(max(text.rfind(q, low, end) for q in quotes), -1)
    if last < 0:
        last = text.rfind("\n", low, end)
    return last + 1 if last >= 0 else end


def chunk_spans(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    spans, start = [], 0
    while True:
        end = start + size
        if end >= len(text):
            return [*spans, (start, len(text))]
        end = min(cut_point(text, start, end), len(text))
        spans.append((start, end))
        if end == len(text):
            return spans
        start = max(start + 1, end - overlap)


def chunks(docs: DataFrame, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, text) -> (doc_id, chunk_id, start, end, text); texts of one chunk stay in the JVM."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(d, i, a, z, t[a:z]) for d, t in zip(frame.doc_id, frame.text) for i, (a, z) in enumerate(chunk_spans(t, size, overlap))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_id", "start", "end", "text"])

    rows = docs.select("doc_id", "text").filter("text is not null")
    n = F.char_length("text")
    whole = rows.filter(n <= size).select("doc_id", F.lit(0).alias("chunk_id"), F.lit(0).alias("start"), n.alias("end"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return whole.unionByName(rows.filter(n > size).mapInPandas(scan, f"doc_id {kind}, chunk_id int, start int, end int, text string"))


#: A token of a diff is a CJK character, a run of letters, of digits or of white space, or any other character: the kinds of code points,
#: of which those of the last three kinds stand in runs.
_ALONE, _LETTER, _DIGIT, _SPACE = range(4)
_KINDS = np.array([_SPACE if chr(c).isspace() else _ALONE for c in range(1 << 16)], np.uint8)
_KINDS[[*range(65, 91), *range(97, 123)]], _KINDS[48:58] = _LETTER, _DIGIT
#: Bytes of text whose pairs are compared at once.
DIFF_BYTES = 4 << 20


def _furthest(reach: np.ndarray, d: int, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One more edit on all diagonals at once: the diagonals, where each path is after the edit, and where after the equal tokens behind it."""
    zero = len(reach) // 2
    k = np.arange(-d, d + 1, 2)
    left, right = reach[zero + k - 1], reach[zero + k + 1]
    x = np.where((k == -d) | ((k != d) & (left < right)), right, left + 1)
    u = x.copy()
    on = np.flatnonzero((u < len(p)) & (u - k < len(q)))
    while len(on):
        on = on[p[u[on]] == q[u[on] - k[on]]]
        u[on] += 1
        on = on[(u[on] < len(p)) & (u[on] - k[on] < len(q))]
    reach[zero + k] = u
    return k, x, u


def _middle(p: np.ndarray, q: np.ndarray) -> tuple[int, int, int, int]:
    """A stretch of equal tokens (x, y, u, v) in the middle of a shortest edit script: the two sides search from both ends at once and keep
    only their furthest places on each diagonal, so space grows with the lengths and time with lengths times distance (Myers 1986)."""
    n, delta, most = len(p), len(p) - len(q), (len(p) + len(q) + 1) // 2
    forward, backward = np.full(2 * most + 5, -1), np.full(2 * most + 5, -1)
    zero = len(forward) // 2
    forward[zero + 1] = backward[zero + 1] = 0
    for d in range(most + 1):
        k, x, u = _furthest(forward, d, p, q)
        if delta % 2:
            met = np.flatnonzero(np.abs(k - delta) < d)
            met = met[u[met] + backward[zero + delta - k[met]] >= n]
            if len(met):
                i = int(met[0])
                return int(x[i]), int(x[i] - k[i]), int(u[i]), int(u[i] - k[i])
        k, x, u = _furthest(backward, d, p[::-1], q[::-1])
        if delta % 2 == 0:
            met = np.flatnonzero(np.abs(k - delta) <= d)
            met = met[u[met] + forward[zero + delta - k[met]] >= n]
            if len(met):
                i = int(met[0])
                return n - int(u[i]), len(q) - int(u[i] - k[i]), n - int(x[i]), len(q) - int(x[i] - k[i])
    raise AssertionError("two paths always meet")


def _equal_runs(p: np.ndarray, q: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(place in p, place in q, length) of the equal stretches of a shortest edit script, in order."""

    def same(a: np.ndarray, b: np.ndarray) -> int:
        k = min(len(a), len(b))
        differ = np.flatnonzero(a[:k] != b[:k])
        return int(differ[0]) if len(differ) else k

    # Ranges of both sides that are still to be compared, or that are equal, the next one on top.
    stack = [(0, len(p), 0, len(q), False)]
    while stack:
        a, b, c, d, equal = stack.pop()
        if equal:
            yield a, c, b - a
            continue
        head = same(p[a:b], q[c:d])
        tail = same(p[a + head : b][::-1], q[c + head : d][::-1])
        if head:
            yield a, c, head
        if tail:
            stack.append((b - tail, b, d - tail, d, True))
        a, b, c, d = a + head, b - tail, c + head, d - tail
        if a < b and c < d:
            i, j, u, v = _middle(p[a:b], q[c:d])
            stack += [(a + u, b, c + v, d, False), (a + i, a + u, c + j, c + v, True), (a, a + i, c, c + j, False)]


def _kept(p: np.ndarray, q: np.ndarray, of_p: np.ndarray, of_q: np.ndarray, pairs: int) -> tuple[np.ndarray, np.ndarray]:
    """The places in p and in q of the tokens that stay, for shortest scripts of many pairs: token numbers, and the pair of each token, in order.

    Tokens that one side alone has never stay, so only the others are compared. Where they are the same on both sides, which is seen for all
    pairs at once, all of them stay; the other pairs are searched one by one.
    """
    size = np.int64(max(p.max(initial=0), q.max(initial=0)) + 1)
    key_p, key_q = of_p * size + p, of_q * size + q
    has = lambda some, other: np.flatnonzero(pc.is_in(pa.array(some), pa.array(other)).to_numpy(zero_copy_only=False))
    in_p, in_q = has(key_p, key_q), has(key_q, key_p)
    n, m = (np.bincount(of[some], minlength=pairs) for of, some in ((of_p, in_p), (of_q, in_q)))
    level = n == m
    some_p, some_q = in_p[level[of_p[in_p]]], in_q[level[of_q[in_q]]]
    same = level & (np.bincount(of_p[some_p], p[some_p] != q[some_q], minlength=pairs) == 0)
    keep = same[of_p[some_p]]
    found = [(some_p[keep], some_q[keep])]
    end_p, end_q = np.cumsum(n), np.cumsum(m)
    for pair in np.flatnonzero(~same & (n > 0)).tolist():
        x, y = in_p[end_p[pair] - n[pair] : end_p[pair]], in_q[end_q[pair] - m[pair] : end_q[pair]]
        found += [(x[i : i + k], y[j : j + k]) for i, j, k in _equal_runs(p[x], q[y])]
    stay_p, stay_q = (np.concatenate(side) for side in zip(*found))
    order = np.argsort(stay_p, kind="stable")
    return stay_p[order], stay_q[order]


def edit_steps(x: list[str], y: list[str]) -> Iterator[tuple[str, list[str]]]:
    """A shortest script of insertions and deletions, in order, as (equal, delete or insert, tokens)."""
    number: dict[str, int] = {}
    p, q = (np.array([number.setdefault(t, len(number)) for t in side], np.int64) for side in (x, y))
    a = b = 0
    for u, v in zip(*(k.tolist() for k in _kept(p, q, np.zeros(len(p), np.int64), np.zeros(len(q), np.int64), 1))):
        yield from (("delete", x[a:u]), ("insert", y[b:v]), ("equal", x[u : u + 1]))
        a, b = u + 1, v + 1
    yield from (("delete", x[a:]), ("insert", y[b:]))


def _token_starts(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All texts as UTF-8, the byte where each token begins (and the end of all), and the number of each text's tokens."""
    body = "".join(texts)
    points = np.frombuffer(body.encode("utf-32-le"), np.uint32)
    kinds = _KINDS[np.minimum(points, len(_KINDS) - 1)]
    begins = np.ones(len(points) + 1, bool)
    begins[1:-1] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == _ALONE)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    begins[ends] = True
    width = 1 + (points >= 0x80).astype(np.uint8) + (points >= 0x800) + (points >= 0x10000)
    starts = np.flatnonzero(begins)
    counts = np.diff(np.searchsorted(starts, ends), prepend=0)
    return body.encode(), np.concatenate([[0], np.cumsum(width, dtype=np.int64)])[starts], counts


def _cut(body: bytes, starts: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(np.ascontiguousarray(starts, np.int64).tobytes()), pa.py_buffer(body)])


def diffs(a: list[str], b: list[str]) -> pa.Array:
    """Shortest edit scripts over tokens, for each pair of texts a list of struct(type, value): equal, delete or insert, and the text;
    neighbours of one kind are joined. All pairs are cut into tokens, numbered and compared at once, as arrays."""
    body, starts, counts = _token_starts([*a, *b])
    numbers = _cut(body, starts).dictionary_encode().indices.to_numpy().astype(np.int64)
    n, m = counts[: len(a)], counts[len(a) :]
    of_p, of_q = (np.repeat(np.arange(len(a)), c) for c in (n, m))
    half = len(of_p)
    stay_p, stay_q = _kept(numbers[:half], numbers[half:], of_p, of_q, len(a))
    # Stretches that stay, and an empty one at the end of each pair, so that each has what is deleted and inserted before it.
    pair = of_p[stay_p]
    cut = np.flatnonzero(np.r_[True, (np.diff(stay_p) != 1) | (np.diff(stay_q) != 1) | (np.diff(pair) != 0)]) if len(pair) else np.zeros(0, np.int64)
    length = np.diff(np.r_[cut, len(pair)])
    order = np.argsort(np.r_[pair[cut], np.arange(len(a))], kind="stable")
    of = np.r_[pair[cut], np.arange(len(a))][order]
    u, v = np.r_[stay_p[cut], np.cumsum(n)][order], np.r_[stay_q[cut], np.cumsum(m)][order]
    length = np.r_[length, np.zeros(len(a), np.int64)][order]
    before_u, before_v = np.r_[0, u + length][:-1], np.r_[0, v + length][:-1]
    # Three parts for each: deleted, inserted, equal; from which token to which.
    begin, end = (np.stack(side, axis=1).ravel() for side in ((before_u, before_v + half, u), (u, v + half, u + length)))
    some = np.flatnonzero(begin < end)
    at = starts[np.stack([begin[some], end[some]], axis=1)]
    # What is taken from both sides, in order of place there, is cut out of the bytes in one go: between two parts lies what isn't taken.
    values = _cut(body, np.r_[np.sort(at.ravel()), len(body)]).take(pa.array(2 * np.argsort(np.argsort(at[:, 0]))))
    kinds = pa.array(["delete", "insert", "equal"]).take(pa.array(some % 3))
    offsets = np.searchsorted(some // 3, np.r_[0, np.searchsorted(of, np.arange(len(a)), "right")])
    parts = pa.StructArray.from_arrays([kinds, values.cast(pa.large_string()).cast(pa.string())], names=["type", "value"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), parts)


def diff_tokens(a: str, b: str) -> list[tuple[str, str]]:
    """A shortest edit script over tokens as (equal, delete or insert, text), neighbours of one kind joined."""
    return [(o["type"], o["value"]) for o in diffs([a], [b])[0].as_py()]


def paragraph_diff(review: DataFrame) -> DataFrame:
    """(doc_id, idx, original_text, suggested_text) -> doc_id, idx, ops array of struct(type, value)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = ([t or "" for t in batch.column(c).to_pylist()] for c in ("original_text", "suggested_text"))
            held = np.cumsum([len(x) + len(y) for x, y in zip(a, b)], dtype=np.int64) // DIFF_BYTES
            for some in np.split(np.arange(len(a)), np.flatnonzero(np.diff(held)) + 1) if len(a) else []:
                first, last = int(some[0]), int(some[-1]) + 1
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("idx"), diffs(a[first:last], b[first:last])], names=["doc_id", "idx", "ops"])

    kind = review.schema["doc_id"].dataType.simpleString()
    rows = review.select("doc_id", F.col("idx").cast("int").alias("idx"), "original_text", "suggested_text")
    return rows.mapInArrow(scan, f"doc_id {kind}, idx int, ops array<struct<type:string,value:string>>")
