"""Repair suggestions, reviewer decisions, and the text they make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import positional_similarity, utrim

# Marks that a model may move from the end of a paragraph to its start.
ENDS = "[。！？，；：、]"
# Words in answers that refuse, and in errors that may pass.
REFUSALS = "high risk|rejected|refused|cannot comply|not allowed|content policy|safety filter|违规|拒绝|无法处理|不合规"
RETRYABLE = "429|500|502|503|504|timeout|connection reset|EOF|broken pipe"


def repair_verdict(original: Column, suggested: Column) -> Column:
    """ok, or why a repair is refused: empty, moved_mark, short_changed, length, distance."""
    a, b = F.char_length(original), F.char_length(suggested)
    longer = F.greatest(a, b)
    first, last = F.left(suggested, F.lit(1)), F.right(original, F.lit(1))
    moved = first.rlike(ENDS) & (first == last) & (F.left(original, F.lit(1)) != first)
    differ = F.abs(a - b)
    far = F.when(longer <= 500, F.levenshtein(original, suggested) / longer > 0.25).otherwise(F.lit(False))
    return (
        F.when((a == 0) | (b == 0) | a.isNull() | b.isNull(), "empty")
        .when(moved, "moved_mark")
        .when((F.least(a, b) < 15) & (a != b), "short_changed")
        .when((differ > 2) & (differ / longer > 0.2), "length")
        .when(far, "distance")
        .otherwise("ok")
    )


def bad_rewrite(chunk: Column, output: Column, finish: Column) -> Column:
    """Whether a block rewrite is refused: cut off, much shorter than its input, or a short refusal."""
    out = utrim(output)
    n, m = F.char_length(chunk), F.char_length(out)
    return (finish == "length") | ((n > 100) & (m < F.floor(n * 3 / 10))) | ((m < 200) & F.lower(out).rlike(REFUSALS))


def retryable(error: Column) -> Column:
    return error.rlike(RETRYABLE)


def changed_rows(paragraphs: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Paragraphs (doc_id, idx, text) whose suggestion (doc_id, idx, suggested_text) differs and passes the checks."""
    both = paragraphs.join(suggestions, ["doc_id", "idx"])
    fits = (F.col("text") != F.col("suggested_text")) & (repair_verdict(F.col("text"), F.col("suggested_text")) == "ok")
    return both.filter(fits).select("doc_id", "idx", F.col("text").alias("original_text"), "suggested_text", F.lit("llm_repair").alias("kind"), F.lit("pending").alias("status"))


def apply_review(lines: DataFrame, review: DataFrame) -> DataFrame:
    """Baseline lines (doc_id, idx, text) with decisions -> (doc_id, text)."""
    decided = lines.join(review.select("doc_id", "idx", "suggested_text", "edited_text", "kind", "status"), ["doc_id", "idx"], "left")
    drop = F.coalesce((F.col("status") == "approved") & (F.col("kind") == "duplicate_paragraph"), F.lit(False))
    text = F.when(F.col("status") == "approved", F.regexp_replace("suggested_text", "[\r\n]", "")).when(F.col("status") == "edited", F.col("edited_text")).otherwise(F.col("text"))
    kept = decided.withColumn("text", text).filter(~drop)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda p: p["text"])
    return kept.groupBy("doc_id").agg(F.array_join(parts, "\n").alias("text"))


def apply_suggestions(docs: DataFrame, changes: DataFrame) -> DataFrame:
    """Folds change rows (doc_id, kind, original, replacement, position) into (doc_id, text), the highest position first.

    Paragraph kinds replace (or drop) the first blank-line part with at least 0.6 of its characters equal; character kinds
    replace everywhere; other kinds the first match. A document's changes are bounded by one document.
    """

    def paragraph(text: Column, c: Column) -> Column:
        alike = lambda p: (F.char_length(utrim(p)) > 0) & (positional_similarity(utrim(c["original"]), utrim(p)) >= 0.6)
        parts = F.split(text, "\n\n")
        hits = F.filter(F.transform(parts, lambda p, i: F.when(alike(p), i)), lambda i: i.isNotNull())
        at = F.get(hits, F.lit(0))
        made = F.when(utrim(c["replacement"]) != "", F.array(c["replacement"])).otherwise(F.expr("cast(array() as array<string>)"))
        return F.when(at.isNull(), text).otherwise(F.array_join(F.concat(F.slice(parts, F.lit(1), at), made, F.slice(parts, at + 2, F.size(parts))), "\n\n"))

    def step(text: Column, c: Column) -> Column:
        place = F.position(c["original"], text)  # of the first match; 0: none
        once = F.when(place > 0, F.concat(F.substr(text, F.lit(1), place - 1), c["replacement"], F.substr(text, place + F.char_length(c["original"])))).otherwise(text)
        return (
            F.when(c["original"] == "", text)
            .when(c["kind"].isin("duplicate_paragraph", "advertisement"), paragraph(text, c))
            .when(c["kind"].isin("character_correction", "typo_correction", "text_deletion", "text_insertion"), F.replace(text, c["original"], c["replacement"]))
            .otherwise(once)
        )

    rows = changes.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("position")).alias("p"), "kind", "original", "replacement"))).alias("changes"))
    return docs.join(rows, "doc_id", "left").select("doc_id", F.when(F.col("changes").isNull(), F.col("text")).otherwise(F.aggregate("changes", F.col("text"), step)).alias("text"))


def review_progress(review: DataFrame) -> DataFrame:
    """Per document: total, resolved, percent, complete."""
    done = F.col("status").isin("approved", "rejected", "edited")
    counted = review.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(done).alias("resolved"))
    return counted.withColumn("percent", F.floor(F.col("resolved") * 100 / F.col("total")).cast("long")).withColumn("complete", F.col("total") == F.col("resolved"))


def decide_all(review: DataFrame, files: DataFrame, status: str, now: str) -> DataFrame:
    """Pending rows of the given documents take a status and a time; a status other than approved or rejected clears the time."""
    hit = review.join(files.select("doc_id").distinct().withColumn("hit_", F.lit(True)), "doc_id", "left")
    change = F.col("hit_").isNotNull() & (F.col("status") == "pending")
    time = F.lit(now).cast("timestamp_ntz") if status in ("approved", "rejected") else F.lit(None).cast("timestamp_ntz")
    return hit.withColumn("resolved_at", F.when(change, time)).withColumn("status", F.when(change, F.lit(status)).otherwise(F.col("status"))).drop("hit_")
