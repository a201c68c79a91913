"""Column functions over text. Lengths and places are code points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType

# White space that a full trim removes, as a regex class that Java and RE2 read alike.
WHITE = r"[\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
SPACES = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
TRIM = rf"^{WHITE}+|{WHITE}+\z"
#: The same trim for Java, which tries the parts of a class one by one: most characters are in neither of these two ranges.
JAVA_WHITE = rf"[[\x09-\x20&&[\x09-\x0D\x20]][\x{{85}}-\x{{3000}}&&{WHITE}]]"
JAVA_TRIM = rf"^{JAVA_WHITE}+|{JAVA_WHITE}+\z"
# Punctuation that plays no part when paragraphs are compared.
MARKS = "，。！？；：【】《》、—…～「」『』〈〉“”‘’·"
#: Ranges that have all of them, and none of what Latin, Greek or Cyrillic texts are made of.
MARKS_RANGES = "[\u00B7\u2014-\uFF5E]"


def utrim(text: Column) -> Column:
    """Trims all Unicode white space; `trim` alone leaves the wide indents of Chinese paragraphs."""
    return F.regexp_replace(text, JAVA_TRIM, "")


def utrim_named(text: Column) -> Column:
    """utrim of what costs nothing to name several times (a column, a lambda's variable): few texts end in white space, so few meet the regex."""
    return F.when(F.instr(F.lit(SPACES), F.substring(text, -1, 1)) > 0, utrim(text)).otherwise(F.ltrim(text, F.lit(SPACES)))


def count_of(text: Column, part: str) -> Column:
    """How often a literal occurs, without overlaps."""
    return F.expr("0") + (F.char_length(text) - F.char_length(F.replace(text, F.lit(part), F.lit("")))) / F.lit(len(part))


def normalize_paragraph(text: Column) -> Column:
    """Without the marks of MARKS, trimmed; spaces and brackets stay."""
    return utrim(F.translate(text, MARKS, ""))


def without_marks(text: Column) -> Column:
    """A named text without the marks of MARKS. `translate` has an object a character, so only texts with a character of their ranges go there."""
    return F.when(text.rlike(MARKS_RANGES), F.translate(text, MARKS, "")).otherwise(text)


def content_md5(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def positional_similarity(a: Column, b: Column) -> Column:
    """Share of equal characters at equal places over the longer length; 0 for two empty texts."""
    chars = lambda t: F.filter(F.split(t, ""), lambda c: c != "")
    same = F.aggregate(F.zip_with(chars(a), chars(b), lambda x, y: (x == y).cast("int")), F.lit(0), lambda acc, x: acc + F.coalesce(x, F.lit(0)))
    longer = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longer > 0, same / longer).otherwise(F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 for a zero vector or unequal lengths."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms).otherwise(F.lit(0.0))


# Separators between author and title in file names, in order of trial.
SEPARATORS = ("-", "—", "·", "_")


def parse_filename(name: Column) -> Column:
    """struct(author, title) from a file name without its path.

    The first separator of SEPARATORS with text on both sides splits it; the author is the left part if it has 1 to 10 characters,
    else the right part if that has, else the left part.
    """
    base = utrim(F.regexp_replace(name, r"\.[^.]*\z", ""))
    found = F.struct(F.lit("").alias("author"), base.alias("title"))
    for sep in reversed(SEPARATORS):
        at = F.instr(base, sep)
        left, right = utrim(F.substr(base, F.lit(1), at - 1)), utrim(F.substr(base, at + 1))
        author = lambda t: F.char_length(t).between(1, 10)
        swap = ~author(left) & author(right)
        here = F.struct(F.when(swap, right).otherwise(left).alias("author"), F.when(swap, left).otherwise(right).alias("title"))
        found = F.when((at > 1) & (at < F.char_length(base)), here).otherwise(found)
    return found


#: The marks whose densities are features, and the byte values (two MD5 digests' share) that are.
DENSITY_MARKS, DIGEST_BYTES = "。，！？：；", 24


@F.pandas_udf(ArrayType(DoubleType()))
def _features(text: pd.Series, digests: pd.Series) -> pd.Series:
    """A batch at once: code points in one array, sums by text; digests as bytes of one string."""
    texts = text.fillna("").tolist()
    n = np.array([len(t) for t in texts])
    points = np.frombuffer("".join([t + "\0" for t in texts]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    first = np.cumsum(n + 1) - n - 1
    summed = lambda x: np.add.reduceat(x, first) / np.maximum(n, 1)
    columns = [np.minimum(n / 500.0, 1.0), *(summed((points == ord(m)).astype(np.int64)) for m in DENSITY_MARKS), np.minimum(summed(points) / 65536.0, 1.0)]
    raw = np.frombuffer(bytes.fromhex("".join(d[: 2 * DIGEST_BYTES] for d in digests)), np.uint8).reshape(-1, DIGEST_BYTES) / 256.0
    found = np.concatenate([np.stack(columns, axis=1), raw], axis=1)
    return pd.Series([None if t is None else v for t, v in zip(text, found)])


def vector_digests(norm: Column) -> Column:
    """The two MD5 values, one behind the other, that a vector has of the normalised text; the first is that of the text itself."""
    norm = F.coalesce(norm, F.lit(""))
    return F.concat(F.md5(norm.cast("binary")), F.md5(F.concat(F.lit("quire:"), norm).cast("binary")))


def local_vector(text: Column, digests: Column | None = None) -> Column:
    """32 features: length, densities of six marks, mean code point, and 24 bytes of two MD5 values of the normalised text.

    Null text gives null. The text is normalised and digested once (digests: what the caller has of it); a vectorised task counts code points.
    """
    return _features(text, vector_digests(normalize_paragraph(text)) if digests is None else digests)


def distance(a: str, b: str) -> int:
    """Levenshtein distance: all cells of a row at once as the bits of whole numbers (Myers 1999, Hyyro 2003)."""
    if len(a) < len(b):
        a, b = b, a
    head, most = 0, len(b)
    while head < most:  # the longest common start, by halves
        half = (head + most + 1) // 2
        if a[head:half] == b[head:half]:
            head = half
        else:
            most = half - 1
    tail, most = 0, len(b) - head
    while tail < most:
        half = (tail + most + 1) // 2
        if a[len(a) - half : len(a) - tail] == b[len(b) - half : len(b) - tail]:
            tail = half
        else:
            most = half - 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not b:
        return len(a)
    n = len(a)
    points = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), np.uint32)
    # Places of each character of b in a, as bits.
    places = {c: int.from_bytes(np.packbits(points == ord(c), bitorder="little").tobytes(), "little") for c in set(b)}
    every = (1 << n) - 1
    up, down, found = every, 0, n
    for c in b:
        same = places[c]
        flat = (((same & up) + up) ^ up) | same
        more, less = down | (every & ~(flat | up)), up & flat
        found += (more >> (n - 1)) - (less >> (n - 1))
        more, steep = (more << 1) | 1, same | down
        up, down = (less << 1 | ~(steep | more)) & every, more & steep & every
    return found


@F.pandas_udf(IntegerType())
def _distances(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else distance(x, y) for x, y in zip(a, b)], dtype="Int32")


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of whole texts. Time grows with the product of the parts that differ, over the bits of a word."""
    return _distances(a, b)
