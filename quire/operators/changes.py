"""Change records of cleaning: what each step replaced, by what, and where; enough to undo it.

Steps run in order on the running text. For each step the text is split at its hits; a hit's record holds the length of the part before
it, and an Arrow task over those numbers alone turns them into places: in the running text of the step, and, through the steps before,
in the text as it was given. Texts and hits stay column expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from quire.functions.text import JAVA_TRIM, TRIM
from quire.operators import clean


@dataclass(frozen=True)
class Step:
    """Hits of a pattern, none of them empty, and what replaces a hit."""

    stage: str
    kind: str
    pattern: str
    by: str | Callable[[Column], Column]
    confidence: float = 0.0
    #: The same hits in a form that Java finds faster.
    java: str | None = None

    def replacement(self, hit: Column) -> Column:
        return F.lit(self.by) if isinstance(self.by, str) else self.by(hit)


def one_of(chars: str, group: int = 14) -> str:
    """A class of BMP characters for Java, which tries a class's characters one by one: neighbours stand behind their common range, and all
    of them behind the range of the whole, so that other characters are done after one comparison."""
    points = sorted({ord(c) for c in chars})
    span = lambda part: rf"\x{{{part[0]:04X}}}-\x{{{part[-1]:04X}}}"
    parts = [points[i : i + group] for i in range(0, len(points), group)]
    return f"[{span(points)}&&[" + "".join(f"[{span(part)}&&[{''.join(map(chr, part))}]]" for part in parts) + "]]"


def _steps(stage: str, kind: str, *pairs: tuple[str, str]) -> list[Step]:
    return [Step(stage, kind, what, by) for what, by in pairs]


ADS_BASIC = _steps("basic", "advertisement", *[(p, "") for p in clean.ADS])
ADS_PRE = _steps("pre", "advertisement", *[(p, "") for p in clean.ADS_PRE])
_MARKER = lambda hit: F.concat(F.lit(clean.MARKER[0]), F.char_length(hit).cast("string"), F.lit(clean.MARKER[1]))
PRE = [
    *[Step("pre", "garbled", p, _MARKER, 1.0) for p in clean.GARBLED],
    *_steps("pre", "control", (clean.CONTROL, "")),
    *ADS_PRE,
    *_steps("pre", "whitespace", ("[ \t\f\r]{2,}|[\t\f\r]", " "), (" \n", "\n"), ("\n ", "\n"), ("\n{3,}", "\n\n"), (TRIM, "")),
]
BASIC = [
    *_steps("basic", "html_entity", *clean.ENTITIES.items()),
    Step("basic", "punctuation", clean.NEAR_HAN, lambda hit: F.translate(hit, clean.HALF, clean.FULL)),
    *_steps("basic", "control", (clean.CONTROL, "")),
    *_steps("basic", "whitespace", ("\r\n", "\n"), ("\r", "\n"), ("\n{3,}", "\n\n"), ("[ \t]+(?=\n|\\z)", ""), ("[ \t]{2,}", " "), (TRIM, "")),
    Step("basic", "traditional", f"[{clean.TRADITIONAL}]", lambda hit: F.translate(hit, clean.TRADITIONAL, clean.SIMPLIFIED), java=one_of(clean.TRADITIONAL)),
    *ADS_BASIC,
]
#: All that `clean.preprocess` and then `clean.basic_clean` do.
ALL = PRE + BASIC


def places_of(step: np.ndarray, gap: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of one text's records, in order of step and hit: in the step's text and in the given text.

    `gap` is the length between a hit and the one before it, `before` and `after` the lengths of the hit and its replacement. A place within
    what an earlier step wrote goes back to where that hit began.
    """
    here = np.zeros(len(step), np.int64)
    bounds = np.flatnonzero(np.r_[True, step[1:] != step[:-1]]) if len(step) else np.zeros(0, np.int64)
    source, maps = np.zeros(len(step), np.int64), []
    for a, b in zip(bounds, np.r_[bounds[1:], len(step)]):
        ends = np.cumsum(gap[a:b] + before[a:b])
        here[a:b] = ends - before[a:b]
        place = here[a:b].copy()
        for old, shift, written, length in reversed(maps):
            k = np.searchsorted(written, place, "right") - 1
            inside = (k >= 0) & (place < written[k] + length[k])
            place = np.where(inside, old[k], place - np.where(k >= 0, shift[k], 0))
        source[a:b] = place
        shift = np.cumsum(after[a:b] - before[a:b])
        maps.append((here[a:b], shift, here[a:b] + shift - (after[a:b] - before[a:b]), after[a:b]))
    return here, source


@F.pandas_udf(ArrayType(StructType([StructField(c, LongType()) for c in ("nth", "position", "source_position")])))
def _places(step: pd.Series, gap: pd.Series, before: pd.Series, after: pd.Series) -> pd.Series:
    out = []
    for row in zip(step, gap, before, after):
        columns = [np.asarray(c, np.int64) for c in row]
        here, source = places_of(*columns)
        first = np.searchsorted(columns[0], columns[0])
        out.append([{"nth": n, "position": a, "source_position": b} for n, a, b in zip((np.arange(len(first)) - first + 1).tolist(), here.tolist(), source.tolist())])
    return pd.Series(out)


def logged(docs: DataFrame, steps: list[Step] = ALL) -> DataFrame:
    """docs with the steps done on `text`, and `changes`: an array of (step, nth, stage, kind, original, replacement, position,
    source_position, confidence) in the order in which they were made. Steps and hits count from 1; null texts have no changes."""
    none = F.expr("cast(array() as array<struct<step:int,original:string,replacement:string,gap:int>>)")
    df = docs.withColumn("log_", none)
    for number, step in enumerate(steps, 1):
        pattern = JAVA_TRIM if step.pattern == TRIM else step.java or step.pattern
        df = df.withColumn("hits_", F.regexp_extract_all(F.col("text"), F.lit(pattern), F.lit(0)))
        some = F.size("hits_") > 0
        df = df.withColumn("parts_", F.when(some, F.split("text", pattern, -1)))
        record = lambda hit, i: F.struct(F.lit(number).alias("step"), hit.alias("original"), step.replacement(hit).alias("replacement"), F.char_length(F.get("parts_", i)).alias("gap"))  # noqa: B023, E731
        df = df.withColumn("log_", F.when(some, F.concat("log_", F.transform("hits_", record))).otherwise(F.col("log_")))
        whole = F.array_join(F.zip_with("parts_", "hits_", lambda part, hit: F.concat(part, F.when(hit.isNull(), "").otherwise(step.replacement(hit)))), "")  # noqa: B023
        df = df.withColumn("text", F.when(some, whole).otherwise(F.col("text")))
    numbers = lambda name, of: F.transform("log_", lambda r: of(r[name]))
    plain, length = (lambda c: c), F.char_length
    # Declared non-deterministic, so that no filter on the records is pushed into the chain, which would write it out many times over.
    df = df.withColumn("places_", _places.asNondeterministic()(numbers("step", plain), numbers("gap", plain), numbers("original", length), numbers("replacement", length)))
    of = lambda r, what: F.get(F.array(*[F.lit(getattr(s, what)) for s in steps]), r["step"] - 1).alias(what)
    merged = F.zip_with(
        "log_",
        "places_",
        lambda r, p: F.struct(r["step"].alias("step"), p["nth"].alias("nth"), of(r, "stage"), of(r, "kind"), r["original"].alias("original"), r["replacement"].alias("replacement"), p["position"].alias("position"), p["source_position"].alias("source_position"), of(r, "confidence")),
    )
    return df.withColumn("changes", merged).drop("log_", "hits_", "parts_", "places_")


def change_rows(docs: DataFrame, steps: list[Step] = ALL, key: str = "doc_id") -> DataFrame:
    """A row for each change of each document."""
    return logged(docs.select(key, "text"), steps).select(key, F.explode("changes").alias("c")).select(key, "c.*")


@F.pandas_udf(StringType())
def _undone(text: pd.Series, step: pd.Series, position: pd.Series, original: pd.Series, replacement: pd.Series) -> pd.Series:
    out = []
    for now, *columns in zip(text, step, position, original, replacement):
        steps = np.asarray(columns[0] if columns[0] is not None else [], np.int64)
        bounds = np.flatnonzero(np.r_[True, steps[1:] != steps[:-1]]) if len(steps) else []
        for a, b in reversed(list(zip(bounds, [*bounds[1:], len(steps)]))):
            parts, at, shift = [], 0, 0
            for place, before, after in zip(*(c[a:b] for c in columns[1:])):
                parts += [now[at : place + shift], before]
                at = place + shift + len(after)
                shift += len(after) - len(before)
            now = "".join([*parts, now[at:]])
        out.append(now)
    return pd.Series(out)


def undone(cleaned: DataFrame, changes: str = "changes") -> DataFrame:
    """`text` as it was before the changes of a row, an array as `logged` makes it."""
    column = lambda name: F.transform(changes, lambda r: r[name])
    return cleaned.withColumn("text", _undone(F.col("text"), column("step"), column("position"), column("original"), column("replacement")))
