"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance, shrunk towards the diagonal of the pooled one. The score is the share of class 1
by the difference of log densities, half a Mahalanobis distance and the log determinant each, from Cholesky factors that
are computed once. Statistics of the labelled rows (`most` of each class at most, chosen by hash) are summed by Spark;
only sums reach the driver.

Defined cases: null text is empty; an empty text has statistics too (all 0) and gets a score; if a class is missing,
every score is the share of class 1 among the labels (0.5 without any); null labels are not learned from; rows that
repeat an id are scored each; an empty table stays empty; a very long text is counted whole; equal log densities give
the score 0.5; other columns stay, but one named score is replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import bounded_sample, crc_mod, released, schema_of, table, text_parts

THRESHOLD = 0.7
TRAINING_ROWS = 20_000
#: Weight of the pooled diagonal in each covariance, and the least variance.
SHRINKAGE, FLOOR = 0.15, 1e-4
AT_ONCE = 2 << 20
# Classes of ASCII characters.
SYMBOLS, MARKS = b"!#$%&*+/<=>@\\^_`{|}~", b".,;:'\"?()-"
NAMES = ("words", "word_length", "upper", "digits", "symbols", "marks", "types", "same_next", "top_word", "lines", "line_words", "same_lines", "symbol_words", "short_words", "spaces", "entropy", "longest_run", "lower_start")


def statistics(text: str | None) -> list[float]:
    """Counts and shares of one text, brought near a normal shape by logarithms and roots."""
    text = text or ""
    if not text.strip():
        return [0.0] * len(NAMES)
    raw = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = len(raw)
    words = text.split()
    w = len(words)
    seen = Counter(words)
    same = [a == b for a, b in zip(words, words[1:])]
    run = longest = 1
    for s in same:
        run = run + 1 if s else 1
        if run > longest:
            longest = run
    lines = [x for x in text.split("\n") if x.strip()]
    p = counts[counts > 0] / n
    share = lambda k: float(np.log1p(100.0 * k))
    upper, lower = counts[65:91].sum(), counts[97:123].sum()
    return [
        float(np.log1p(w)),
        float(np.log1p(n / w)),
        share(upper / max(1, upper + lower)),
        share(counts[48:58].sum() / n),
        share(sum(counts[c] for c in SYMBOLS) / n),
        share(sum(counts[c] for c in MARKS) / n),
        float(np.log1p(len(seen)) / np.log1p(w)),
        share(sum(same) / w),
        float(np.sqrt(max(seen.values()) / w)),
        float(np.log1p(len(lines))),
        float(np.log1p(w / max(1, len(lines)))),
        share(1 - len(set(lines)) / max(1, len(lines))),
        share(sum(c for x, c in seen.items() if ord(x[-1]) < 128 and x[-1].encode() in SYMBOLS) / w),
        float(sum(c for x, c in seen.items() if len(x) <= 3) / w),
        share(counts[[9, 10, 13, 32]].sum() / n),
        float(-(p * np.log2(p)).sum()),
        float(np.log(longest)),
        float(sum(c for x, c in seen.items() if x[0].islower()) / w),
    ]


class Discriminant:
    """Means, Cholesky factors and priors of the two classes."""

    def __init__(self, n: np.ndarray, sums: np.ndarray, products: np.ndarray):
        self.share = float(n[1] / n.sum()) if n.sum() else 0.5
        self.parts = []
        if (n < 2).any():
            return
        means = sums / n[:, None]
        covariances = products / n[:, None, None] - means[:, :, None] * means[:, None, :]
        pooled = np.diag(np.maximum(FLOOR, (covariances * (n / n.sum())[:, None, None]).sum(axis=0).diagonal()))
        for c in (0, 1):
            factor = np.linalg.cholesky((1 - SHRINKAGE) * covariances[c] + SHRINKAGE * pooled + FLOOR * np.eye(len(pooled)))
            self.parts.append((means[c], np.linalg.inv(factor), 2 * np.log(factor.diagonal()).sum(), float(np.log(n[c] / n.sum()))))

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.parts:
            return np.full(len(x), self.share)
        logs = [prior - 0.5 * (log_det + (((x - mean) @ inverse.T) ** 2).sum(axis=1)) for mean, inverse, log_det, prior in self.parts]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over a task: class, place in (count, sums, products), value."""
    d = len(NAMES)
    n, s, q = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for batch in batches:
        label = np.array(batch.column(0).to_pylist(), int)
        for part, texts in text_parts(batch.column(1), AT_ONCE, as_bytes=False):
            x, y = np.array([statistics(t) for t in texts]), label[part]
            for c in (0, 1):
                m = x[y == c]
                n[c] += len(m)
                s[c] += m.sum(axis=0)
                q[c] += m.T @ m
    flat = np.concatenate([n[:, None], s, q.reshape(2, -1)], axis=1)
    c, k = np.indices(flat.shape)
    yield pa.RecordBatch.from_arrays([pa.array(c.ravel(), pa.int32()), pa.array(k.ravel(), pa.int32()), pa.array(flat.ravel(), pa.float64())], ["c", "k", "v"])


def train(docs: DataFrame, labels: DataFrame, most: int = TRAINING_ROWS) -> Discriminant:
    """docs (doc_id, text) and labels (doc_id, quality): learns from the labelled documents, `most` of each class at most."""
    rows = labels.select("doc_id", F.col("quality").cast("int").alias("label")).filter("label in (0, 1) and doc_id is not null")
    sample = bounded_sample(rows, "doc_id", "label", most, 1)
    # The sample is bounded by its parameter: two classes of about `most` rows.
    sums = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("label", "text").mapInArrow(released(_moments), "c int, k int, v double").groupBy("c", "k").agg(F.sum("v").alias("v")).toPandas()
    d = len(NAMES)
    flat = np.zeros((2, 1 + d + d * d))
    flat[sums.c, sums.k] = sums.v
    return Discriminant(flat[:, 0], flat[:, 1 : 1 + d], flat[:, 1 + d :].reshape(2, d, d))


def score(docs: DataFrame, model: Discriminant, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds score to the kept columns (all by default)."""
    keep = keep if keep is not None else [c for c in docs.columns if c != "score"]
    rows = docs.select(*keep) if text in keep else docs.select(*keep, F.col(text).alias("text_"))
    at = keep.index(text) if text in keep else len(keep)

    def run(batches):
        for batch in batches:
            for part, mine in text_parts(batch.column(at), AT_ONCE, as_bytes=False):
                found = model.scores(np.array([statistics(t) for t in mine]))
                old = [batch.column(i).slice(part.start, len(mine)) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*old, pa.array(found, pa.float64())], [*keep, "score"])

    return rows.mapInArrow(released(run), schema_of(docs.select(*keep), "score double"))


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").filter(crc_mod(F.col("doc_id"), 4) != 2)


def op1_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"))
    model = train(docs, training_labels(spark, sf_dir))
    return score(docs, model, keep=["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
