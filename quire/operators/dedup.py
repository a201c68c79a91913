"""Exact and near duplicates of paragraphs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.text import local_vector, normalize_paragraph, utrim_named, vector_digests, without_marks

# Least normalised length that takes part, predecessors compared, cosine from which paragraphs are alike.
MIN_LENGTH, WINDOW, THRESHOLD = 5, 300, 0.95


def exact_duplicates(paragraphs: DataFrame, scope: str = "document") -> DataFrame:
    """Adds norm, is_dup and first_idx: paragraphs whose normalised text stood before in their document (or, by scope, in any).

    Windows run over the MD5 of the text, so that keys in the shuffle are short; its length is taken before, so that a caller who
    selects neither norm nor text moves none of them.
    """
    marked = paragraphs.withColumn("norm", normalize_paragraph(F.col("text")))
    marked = marked.withColumn("key_", F.md5(F.col("norm").cast("binary"))).withColumn("long_", F.char_length("norm") >= MIN_LENGTH)
    keys = ["doc_id", "key_"] if scope == "document" else ["key_"]
    w = W.partitionBy(*keys).orderBy("doc_id", "idx")
    return marked.withColumn("is_dup", F.col("long_") & (F.row_number().over(w) > 1)).withColumn("first_idx", F.first("idx").over(w)).drop("key_", "long_")


def duplicate_stats(dups: DataFrame, samples: int = 20, fewer: int = 10, most_chars: int = 5000) -> DataFrame:
    """Per document: duplicates, their characters, the first texts, and whether the list was cut.

    The report keeps `samples` texts, or `fewer` if those are longer than most_chars together.
    """
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy("idx"))
    first = F.transform(F.array_sort(F.collect_list(F.when(F.col("rank_") <= samples, F.struct("idx", "text")))), lambda x: x["text"])
    counted = dups.withColumn("rank_", rank).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("chars"), first.alias("first_"))
    over = F.aggregate("first_", F.lit(0), lambda acc, t: acc + F.char_length(t)) > most_chars
    return counted.select("doc_id", "n", "chars", F.when(over, F.slice("first_", 1, fewer)).otherwise(F.col("first_")).alias("samples"), ((F.col("n") > samples) | over).alias("truncated"))


def near_paragraphs(paragraphs: DataFrame, window: int = WINDOW, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, idx, text) -> (doc_id, idx, near_idx, sim): paragraphs with an earlier, alike one, each marked once, by the nearest.

    Short paragraphs and exact duplicates take no part; the rest meet by their local vectors. Normalised text is made and digested once, for
    duplicates and vectors, and both are made before rows move, so no text does.
    """
    marked = paragraphs.select("doc_id", "idx", "text", without_marks(F.col("text")).alias("bare"))
    marked = marked.select("doc_id", "idx", "text", utrim_named(F.col("bare")).alias("norm"))
    marked = marked.select("doc_id", "idx", "text", vector_digests(F.col("norm")).alias("digests"), (F.char_length("norm") >= MIN_LENGTH).alias("long"))
    made = marked.select("doc_id", "idx", F.substr("digests", F.lit(1), F.lit(32)).alias("key"), "long", local_vector(F.col("text"), F.col("digests")).alias("vec"))
    first = F.row_number().over(W.partitionBy("doc_id", "key").orderBy("idx")) == 1
    vectors = made.withColumn("first", first).filter(F.col("long") & F.col("first")).select(F.col("doc_id").alias("file_id"), "idx", "vec")
    pairs = near_duplicates(vectors, window, threshold, nearest=True)
    return pairs.groupBy(F.col("file_id").alias("doc_id"), F.col("i").alias("idx")).agg(F.max("j").alias("near_idx"), F.max_by("sim", "j").alias("sim"))


#: Places of a file that one group compares, and rows that one matrix product does.
STRETCH, ROWS = 4096, 256


def _stretches(rows: DataFrame, window: int, stretch: int) -> DataFrame:
    """Rows by stretches of a file's places: each in its own, and as an earlier row also in the next ones that its window reaches."""
    own = F.floor(F.col("idx") / stretch).cast("long")
    reach = F.floor((F.col("idx") + window) / stretch).cast("long")
    dealt = rows.select("*", own.alias("own"), F.explode(F.sequence(own, reach)).alias("part"))
    return dealt.select("file_id", "part", F.lit(0).cast("long").alias("other"), (F.col("part") == F.col("own")).alias("later"), F.lit(True).alias("earlier"), "idx", "vec")


def _stretch_pairs(rows: DataFrame, stretch: int) -> DataFrame:
    """Rows by pairs of a file's stretches, so that all rows of a file meet though no group has more than two stretches."""
    own = F.floor(F.col("idx") / stretch).cast("long")
    spans = rows.groupBy("file_id").agg(F.min(own).alias("first_"), F.max(own).alias("last_"))
    dealt = rows.join(spans, "file_id").withColumn("own", own).withColumn("at", F.explode(F.sequence("first_", "last_")))
    later, earlier = F.col("at") <= F.col("own"), F.col("at") >= F.col("own")
    return dealt.select("file_id", F.greatest("own", "at").alias("part"), F.least("own", "at").alias("other"), later.alias("later"), earlier.alias("earlier"), "idx", "vec")


def _matrix(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows of the vectors, padded with zeros, and their lengths; a null or zero vector is a row of zeros, one with a null or NaN is of NaNs."""
    n = np.diff(lists.offsets.to_numpy()) if lists.null_count == 0 else np.array([len(v) if v is not None else 0 for v in lists.to_pylist()])
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    x = np.zeros((len(n), int(n.max(initial=1)) or 1))
    x[np.arange(x.shape[1]) < n[:, None]] = flat
    largest = np.abs(x).max(axis=1)
    x /= np.where(largest > 0, largest, 1.0)[:, None]  # so that squares neither over- nor underflow
    norm = np.sqrt((x * x).sum(axis=1))
    return x / np.where(norm > 0, norm, 1.0)[:, None], np.where(lists.is_null().to_numpy(zero_copy_only=False), -1, n)


def _alike(rows: pa.Table, group: np.ndarray, window: int, threshold: float, nearest: bool) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, sim), i and j as places among rows: whole groups in order, by their numbers from 0, each in order of idx. Blocks of later
    rows, which may be of many groups, against the earlier rows in reach."""
    idx = rows["idx"].to_numpy()
    x, n = _matrix(rows["vec"].combine_chunks())
    begin = np.searchsorted(group, np.arange(group[-1] + 1))
    # Rows by one number. With a window: the idx from their group's first one on, and groups further apart than a window reaches.
    if window:
        most = np.maximum.reduceat(idx, begin) - idx[begin] + window + 1
        place = idx - idx[begin][group] + (np.cumsum(most) - most)[group]
    else:
        place = np.r_[0, np.cumsum((np.diff(idx) != 0) | (np.diff(group) != 0))]
    later, earlier = (np.flatnonzero(rows[c].to_numpy(zero_copy_only=False) & (n >= 0)) for c in ("later", "earlier"))
    before, found = place[earlier], []
    for start in range(0, len(later), ROWS):
        some_later = later[start : start + ROWS]
        low = place[some_later[0]] - window if window else place[begin[group[some_later[0]]]]
        reach = earlier[np.searchsorted(before, low) : np.searchsorted(before, place[some_later[-1]])]
        for end in range(len(reach), 0, -4 * ROWS):  # the nearest ones first
            some = reach[max(0, end - 4 * ROWS) : end]
            sim = x[some_later] @ x[some].T
            sim[n[some_later][:, None] != n[some]] = 0.0
            gap = place[some_later][:, None] - place[some]
            hit = (sim >= threshold) & (gap > 0) & ((gap <= window) if window else group[some_later][:, None] == group[some])
            if nearest:
                one = hit.any(axis=1)
                last = len(some) - 1 - hit[:, ::-1].argmax(axis=1)
                found.append((some_later[one], some[last[one]], sim[one, last[one]]))
                some_later = some_later[~one]
                if not len(some_later):
                    break
            else:
                a, b = np.nonzero(hit)
                found.append((some_later[a], some[b], sim[a, b]))
    return found


def near_duplicates(rows: DataFrame, window: int = WINDOW, threshold: float = THRESHOLD, nearest: bool = False, stretch: int = STRETCH) -> DataFrame:
    """(file_id, idx, vec) -> (file_id, i, j, sim): earlier rows j within `window` places of i that are alike (0: all earlier ones).

    A file's places are cut into stretches, and each is a group of its own, with the rows before it that its window reaches; in it
    blocks of unit vectors are compared by matrix products. With `nearest`, a row gives its nearest hit in each group only, and
    earlier blocks are skipped once it is found. A zero vector, or one of another length, has similarity 0; null vectors have none.
    """
    known = rows.filter(F.col("file_id").isNotNull() & F.col("idx").isNotNull()).select("file_id", F.col("idx").cast("long").alias("idx"), F.col("vec").cast("array<double>").alias("vec"))
    dealt = _stretches(known, window, max(stretch, window)) if window else _stretch_pairs(known, stretch)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def key(b: pa.RecordBatch, at: int) -> tuple:
            return tuple(b.column(c)[at].as_py() for c in ("file_id", "part", "other"))

        def cuts(keys: list[np.ndarray]) -> np.ndarray:
            return np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1

        def keys_of(b) -> list[np.ndarray]:
            return [b.column(c).to_numpy(zero_copy_only=False) if isinstance(b, pa.RecordBatch) else b[c].to_numpy() for c in ("file_id", "part", "other")]

        def done():
            if held:
                whole = pa.Table.from_batches(held)
                group = np.zeros(len(whole), np.int64)
                group[cuts(keys_of(whole))] = 1
                found = _alike(whole, np.cumsum(group), window, threshold, nearest)
                if found:
                    i, j, sim = (np.concatenate(c) for c in zip(*found))
                    file, idx = whole["file_id"].combine_chunks(), whole["idx"].to_numpy()
                    yield pa.RecordBatch.from_arrays([file.take(pa.array(i)), pa.array(idx[i]), pa.array(idx[j]), pa.array(sim)], names=["file_id", "i", "j", "sim"])

        # A batch's whole groups are compared at once, with what is held of the first of them; most files are a few rows.
        for batch in batches:
            if not len(batch):
                continue
            if held and key(held[0], 0) != key(batch, 0):
                yield from done()
                held.clear()
            at = cuts(keys_of(batch))
            last = int(at[-1]) if len(at) else 0
            if last:
                held.append(batch.slice(0, last))
                yield from done()
                held.clear()
            held.append(batch.slice(last))
        yield from done()

    kind, place = rows.schema["file_id"].dataType.simpleString(), rows.schema["idx"].dataType.simpleString()
    ordered = dealt.repartition("file_id", "part", "other").sortWithinPartitions("file_id", "part", "other", "idx")
    found = ordered.mapInArrow(scan, f"file_id {kind}, i long, j long, sim double")
    return found.select("file_id", F.col("i").cast(place).alias("i"), F.col("j").cast(place).alias("j"), "sim")


def duplicates_to_lines(dups: DataFrame, lines: DataFrame) -> DataFrame:
    """Duplicate paragraphs (doc_id, idx, text) with the index of their own raw line: the n-th paragraph of a text is its n-th line."""
    from quire.functions.text import utrim

    nth = lambda df: df.withColumn("nth_", F.row_number().over(W.partitionBy("doc_id", "key_").orderBy("idx")))
    keyed = lambda df: df.withColumn("key_", F.md5(utrim(F.col("text")).cast("binary")))
    places = nth(keyed(lines).filter(utrim(F.col("text")) != "")).select("doc_id", "key_", "nth_", F.col("idx").alias("line"))
    return nth(keyed(dups)).filter("is_dup").join(places, ["doc_id", "key_", "nth_"]).select("doc_id", "idx", "line", "text")
