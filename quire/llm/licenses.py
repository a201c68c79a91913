"""Licence scans: ordered signature rules over normalised words, as Spark expressions.

The text becomes lower-case words with one space between. Where an anchor occurs, the rules of which a keyword
occurs are tried; each match is a detection (start, end in words, rule). A detection is suppressed if another one of at least its
priority contains it (of equal spans and priorities the earlier rule stays). Phrases counted in any case (`base`) are
separate from the rules, and their labels always stay.

Defined cases: null text is empty; an empty text has no words, no labels and score 0; a very long text is scanned whole;
rows that repeat an id are scanned each; an empty table gives an empty result; other columns stay, but ones named like a
result column are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import lower_ascii, table
from quire.llm.license_rules import ANCHORS, WEIGHTS, rules

#: What separates words (fixed pattern): every ASCII character but digits and lower-case letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Phrases that are always counted, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
PRIORITIES = len(WEIGHTS)


def normal(text: Column) -> Column:
    """' word word word ', or two spaces if there is no word."""
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), BETWEEN, " ")), F.lit(" "))


def spaces(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(" "), F.lit("")))


def phrase_places(norm: Column, n_words: Column, phrase: str) -> Column:
    """struct(n, first, last) of the places where the phrase's words stand consecutively; null if there is none."""
    head, _, tail = phrase.partition(" ")
    pieces = F.split(norm, f" {head}(?= {tail} )")
    found = F.struct((F.size(pieces) - 1).alias("n"), spaces(F.get(pieces, F.lit(0))).alias("first"), (n_words - spaces(F.get(pieces, F.size(pieces) - 1))).alias("last"))
    return F.when(F.contains(norm, F.lit(f" {phrase} ")), found)


def detections(norm: Column) -> Column:
    """All matches of the rules as structs (start, neg_end, neg_priority, rule, label), sorted by place, longest first."""
    table_ = F.array(
        *[
            F.struct(F.lit(i).alias("rule"), F.lit(-p).alias("neg_priority"), F.lit(label).alias("label"), F.array(*map(F.lit, words)).alias("keywords"), F.lit(f" (?:{regex})(?= )").alias("regex"))
            for i, (p, label, words, regex) in enumerate(rules())
        ]
    )
    empty = F.expr("named_struct('at', 0, 'out', cast(array() as array<struct<start:int,neg_end:int,neg_priority:int,rule:int,label:string>>))")

    def of_rule(r: Column) -> Column:
        found = F.arrays_zip(F.split(norm, r["regex"]).alias("before"), F.regexp_extract_all(norm, r["regex"], F.lit(0)).alias("match"))

        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + spaces(x["before"])
            end = start + spaces(x["match"])
            one = F.struct(start.alias("start"), (-end).alias("neg_end"), r["neg_priority"].alias("neg_priority"), r["rule"].alias("rule"), r["label"].alias("label"))
            return F.when(x["match"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out")))

        return F.aggregate(found, empty, step, lambda acc: acc["out"])

    return F.sort_array(F.flatten(F.transform(F.filter(table_, lambda r: F.exists(r["keywords"], lambda k: F.contains(norm, k))), of_rule)))


def keep_outer(found: Column) -> Column:
    """Drops what another detection of at least its priority contains; `found` is sorted by place, longest first.

    A container stands earlier in that order, so it is enough to know, per priority, how far the detections so far reach.
    """
    start = F.expr(f"named_struct('reach', array_repeat(-1, {PRIORITIES}), 'out', cast(array() as array<struct<start:int,neg_end:int,neg_priority:int,rule:int,label:string>>))")

    def step(acc: Column, d: Column) -> Column:
        end, priority = -d["neg_end"], -d["neg_priority"]
        held = F.exists(F.slice(acc["reach"], priority, F.lit(PRIORITIES)), lambda r: r >= end)
        reach = F.transform(acc["reach"], lambda r, i: F.when(i == priority - 1, F.greatest(r, end)).otherwise(r))
        return F.struct(reach.alias("reach"), F.when(held, acc["out"]).otherwise(F.concat(acc["out"], F.array(d))).alias("out"))

    return F.aggregate(found, start, step, lambda acc: acc["out"])


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, base (array of struct label, n, first, last) and detections (suppression applied).

    The row's own columns are carried as one struct, so no name of theirs clashes with one used here; only columns that have the name of
    one of the three results are replaced by it.
    """
    own = [c for c in docs.columns if c not in ("n_words", "base", "detections")]
    norm = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row_"), normal(F.col(text)).alias("norm_")).withColumn("n_words", F.greatest(F.lit(0), F.when(F.col("norm_") == "  ", 0).otherwise(spaces(F.col("norm_")) - 1)).cast("long"))
    base = [
        F.when(F.col(f"base_{i}").isNotNull(), F.struct(F.lit(label).alias("label"), *[F.col(f"base_{i}")[k].cast("long").alias(k) for k in ("n", "first", "last")]))
        for i, label in enumerate(BASE.values())
    ]
    for i, phrase in enumerate(BASE):
        norm = norm.withColumn(f"base_{i}", phrase_places(F.col("norm_"), F.col("n_words"), phrase))
    gate = reduce(lambda a, b: a | b, [F.contains("norm_", F.lit(a)) for a in ANCHORS])
    none = F.expr("cast(array() as array<struct<start:int,neg_end:int,neg_priority:int,rule:int,label:string>>)")
    return (
        norm.withColumn("base", F.array_compact(F.array(*base)))
        .withColumn("found_", F.when(gate, detections(F.col("norm_"))).otherwise(none))
        .withColumn("detections", keep_outer(F.col("found_")))
        .select(*[F.col("row_")[c].alias(c) for c in own], "n_words", "base", "detections")
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    base, found = F.col("base"), F.col("detections")
    labels = F.transform(base, lambda b: b["label"])
    weight = F.element_at(F.array(*[F.lit(WEIGHTS[p]) for p in range(1, PRIORITIES + 1)]), F.abs(F.array_min(F.transform(found, lambda d: d["neg_priority"]))))
    listed = lambda xs: F.array_join(F.array_sort(F.array_distinct(xs)), ",")
    return scan(docs).select(
        "doc_id",
        "n_words",
        F.aggregate(base, F.lit(0).cast("long"), lambda acc, b: acc + b["n"]).alias("n_base"),
        F.array_min(F.transform(base, lambda b: b["first"])).alias("first_word"),
        F.array_max(F.transform(base, lambda b: b["last"])).alias("last_word"),
        listed(labels).alias("base_labels"),
        listed(F.concat(labels, F.transform(found, lambda d: d["label"]))).alias("labels"),
        F.greatest(F.when(F.size(found) > 0, weight).otherwise(F.lit(0.0)), F.when(F.size(base) > 0, F.lit(0.9)).otherwise(F.lit(0.0))).alias("score"),
        F.size(found).cast("long").alias("n_detections"),
    )
