"""Removal of passages that repeat across documents, by super-k-mer partitioning.

A window is WINDOW consecutive words of a document. Neighbouring windows that share a minimiser (the least hash of the GRAM-word
grams in them) travel as one packed string to that minimiser's bucket; there equal windows meet, sorting brings them together, and
they are compared word by word. A window that also starts in a document with a smaller id marks its words for removal.

Repeats don't pile up: of equal strings in one chunk of text only those of the smallest document travel, the others are decided
at once. Minimisers with more windows than a bucket holds (found on a sample; the results don't depend on it) are dealt over
several buckets, whose survivors, the windows of the smallest documents there, meet once more by whole windows.

Defined cases: a null or empty text, and one of fewer than WINDOW words, loses nothing. A null id counts as larger than any other.
Rows that repeat an id never take words from each other; each keeps its own result. Whatever stands between words, one space joins
those that stay. Very long texts are read in pieces that overlap by WINDOW - 1 words. Other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.bytewords import hash_words, mix
from quire.llm.common import SPACE_WORD, released, stored, table, text_parts

WINDOW, GRAM = 13, 3
#: Windows that a bucket should have, and the fewest buckets; from half a bucket on a minimiser is dealt over several.
BUCKET_WINDOWS, BUCKETS, HOT_WINDOWS, TASK_WINDOWS = 1 << 21, 256, 20_000, 500_000
#: One document in so many is read for the sizes of buckets. Texts are handled in pieces of so many bytes at most.
SAMPLE, PIECE = 16, 8 << 20
NO_ID = (1 << 63) - 1
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
SPANS = "doc long, digest long, first int, last int"


def pieces(text: bytes, most: int = PIECE) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first word, words): texts of at most `most` bytes as one; longer ones cut at white space, with all windows whole."""
    if len(text) <= most:
        yield 0, text.split()
        return
    tail, at, done = [], 0, 0
    while at < len(text):
        end = min(len(text), at + most)
        while end < len(text) and text[end] not in b" \t\n\v\f\r":
            end += 1
        words = text[at:end].split()
        yield done - len(tail), tail + words
        done, at = done + len(words), end
        tail = (tail + words)[-(WINDOW - 1) :]


def least_grams(h: np.ndarray) -> np.ndarray:
    """The minimiser of each window, from the hashes of words."""
    n = len(h) - GRAM + 1
    g = h[:n].copy()
    for i in range(1, GRAM):
        g = g * _A + h[i : i + n]
    g = mix(g)
    span, width = WINDOW - GRAM + 1, 1
    while 2 * width <= span:  # minima over 2, 4, 8 grams, then two that overlap
        g, width = np.minimum(g[: len(g) - width], g[width:]), 2 * width
    return np.minimum(g[: len(g) - (span - width)], g[span - width :])


class Runs:
    """The super-k-mers of a chunk, as parallel arrays: doc, digest, start (first word), count (windows), least (minimiser), and where
    their words are among the chunk's words: as `numbers` of distinct words, and from which byte of `joined` to which."""

    def __init__(self, batch: list[tuple[int, int, int, list[bytes]]]):
        vocabulary: dict[bytes, int] = defaultdict()
        vocabulary.default_factory = vocabulary.__len__
        sizes = np.array([len(ws) for *_, ws in batch])
        self.numbers = np.fromiter(map(vocabulary.__getitem__, chain.from_iterable(ws for *_, ws in batch)), np.int32, int(sizes.sum()))
        words = list(vocabulary)
        least = least_grams(hash_words([b" ".join(words)])[0][self.numbers])
        of = np.repeat(np.arange(len(batch)), sizes)
        whole = of[: len(least)] == of[WINDOW - 1 :]
        new = np.ones(len(least), bool)
        new[1:] = (least[1:] != least[:-1]) | ~whole[:-1]
        self.begin = np.flatnonzero(new & whole)
        stop = np.append(np.flatnonzero(new), len(least))
        total = np.concatenate([[0], np.cumsum(whole)])
        ends = stop[np.searchsorted(stop, self.begin, "right")]
        self.count = (total[ends] - total[self.begin]).astype(np.int32)  # without windows across two texts
        self.end = self.begin + self.count + (WINDOW - 1)
        self.joined = b" ".join(chain.from_iterable(ws for *_, ws in batch))
        lengths = np.fromiter(map(len, words), np.int64, len(words))[self.numbers] + 1
        at = np.concatenate([[0], np.cumsum(lengths)])
        self.bytes = at[self.begin], at[self.end] - 1
        self.least = least[self.begin]
        row, first = of[self.begin], np.cumsum(sizes) - sizes
        column = lambda i: np.array([b[i] for b in batch])
        self.doc, self.digest = column(0)[row], column(1)[row]
        self.start = (column(2)[row] + self.begin - first[row]).astype(np.int32)

    def travelling(self) -> np.ndarray:
        """Of equal strings, which have the smallest document of the chunk."""
        raw, least = self.numbers.tobytes(), {}
        strings = [raw[a:b] for a, b in zip((4 * self.begin).tolist(), (4 * self.end).tolist())]
        for s, d in zip(strings, self.doc.tolist()):
            if d < least.setdefault(s, d):
                least[s] = d
        return self.doc == np.fromiter(map(least.__getitem__, strings), np.int64, len(strings))

    def packed(self, some: np.ndarray, hot: np.ndarray) -> bytes:
        """Some of the strings, one behind the other, with their arrays."""
        strings = [self.joined[a:b] for a, b in zip(self.bytes[0][some].tolist(), self.bytes[1][some].tolist())]
        return pack([self.doc[some], self.digest[some], self.start[some], self.count[some], hot[some]], b" ".join(strings))


def runs(docs: list[int], digests: list[int], texts: list[bytes], most: int = PIECE) -> Iterator[Runs]:
    """The super-k-mers of all texts, in chunks of about `most` bytes."""
    batch: list[tuple[int, int, int, list[bytes]]] = []
    held = 0
    for doc, digest, text in zip(docs, digests, texts):
        for start, words in pieces(text, most):
            if len(words) >= WINDOW:
                if held > most and batch:
                    yield Runs(batch)
                    batch, held = [], 0
                batch.append((doc, digest, start, words))
                held += sum(map(len, words)) + len(words)
    if batch:
        yield Runs(batch)


def pack(arrays: list[np.ndarray], text: bytes) -> bytes:
    """Arrays of one length and a text, as compressed bytes."""
    body = np.array([len(arrays[0])], "<i8").tobytes() + b"".join(a.tobytes() for a in arrays) + text
    return len(body).to_bytes(8, "little") + pa.Codec("zstd", compression_level=6).compress(body, asbytes=True)


def unpack(blob: bytes, kinds: list[str]) -> tuple[list[np.ndarray], bytes]:
    body = pa.Codec("zstd").decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)
    n, at, found = int.from_bytes(body[:8], "little"), 8, []
    for kind in kinds:
        found.append(np.frombuffer(body, kind, n, at))
        at += found[-1].nbytes
    return found, body[at:]


RUN, SPAN = ["<i8", "<i8", "<i4", "<i4", "?"], ["<i8", "<i8", "<i4", "<i4"]


def word_array(text: bytes) -> pa.Array:
    """Words joined by one space, as an Arrow array over the text's own bytes; each keeps the space behind it."""
    text += b" "
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 0x20) + 1
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.r_[0, ends].astype(np.int32).tobytes()), pa.py_buffer(text)])


class Windows:
    """All windows of one bucket; words are numbers from one dictionary, which Arrow makes from the texts without an object a word."""

    def __init__(self):
        self.parts: list[tuple] = []
        self.words: list[pa.Array] = []

    def add(self, arrays: list[np.ndarray], words: list[bytes]) -> None:
        """Strings by their arrays (RUN) and all their words."""
        self.add_text(arrays, b" ".join(words))

    def add_text(self, arrays: list[np.ndarray], text: bytes) -> None:
        """The same, with the words joined by one space."""
        self.parts.append(tuple(arrays))
        self.words.append(word_array(text))

    def decided(self) -> tuple[pa.RecordBatch, list[tuple] | None]:
        """Spans of windows that start in a smaller document here too; and of the hot strings the other windows, as (doc, digest, places, window)."""
        doc, digest, start, count, hot = (np.concatenate(p) for p in zip(*self.parts))
        # Arrow fills one dictionary over all texts, so each has it whole; unifying them would read it again for each text.
        numbered = pa.chunked_array(self.words).dictionary_encode()
        ids, dictionary = np.concatenate([c.indices.to_numpy() for c in numbered.chunks]), numbered.chunk(0).dictionary
        self.parts.clear()
        self.words.clear()
        offset = np.cumsum(count + (WINDOW - 1)) - count - (WINDOW - 1)
        of = np.repeat(np.arange(len(count)), count)
        within = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        at = offset[of] + within
        key = np.zeros(len(ids) - WINDOW + 1, np.uint64)
        for i in range(WINDOW):
            key = key * _B + (ids[i : i + len(key)].astype(np.uint64) + np.uint64(1)) * _A
        key = key[at]
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.ones(len(order), bool)
        new[1:] = sorted_key[1:] != sorted_key[:-1]
        group = np.cumsum(new) - 1
        shared = np.bincount(group)[group] > 1
        marked = np.zeros(len(of), bool)
        if shared.any():
            members, group = order[shared], group[shared]
            heads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            same = np.cumsum(np.r_[True, group[1:] != group[:-1]]) - 1
            row = lambda x: ids[at[x][:, None] + np.arange(WINDOW)]
            step = 1 << 17
            if any((row(members[i : i + step]) != row(members[heads][same[i : i + step]])).any() for i in range(0, len(members), step)):
                same = np.unique(row(members), axis=0, return_inverse=True)[1].ravel()  # two different windows have one key
                by = np.argsort(same, kind="stable")
                members, same = members[by], same[by]
                heads = np.flatnonzero(np.r_[True, same[1:] != same[:-1]])
                same = np.cumsum(np.r_[True, same[1:] != same[:-1]]) - 1
            mine = doc[of[members]]
            marked[members] = mine > np.minimum.reduceat(mine, heads)[same]
        flagged = np.flatnonzero(marked)
        cut = np.r_[True, (flagged[1:] != flagged[:-1] + 1) | (of[flagged[1:]] != of[flagged[:-1]])] if len(flagged) else np.zeros(0, bool)
        begin = flagged[cut]
        size = np.diff(np.r_[np.flatnonzero(cut), len(flagged)])
        first = start[of[begin]] + within[begin]
        spans = span_batch(doc[of[begin]], digest[of[begin]], first, first + size + (WINDOW - 1))
        left = np.flatnonzero(~marked & hot[of])
        if not len(left):
            return spans, None
        words, places = [w[:-1] for w in dictionary.to_pylist()], defaultdict(list)
        numbers = ids[at[left][:, None] + np.arange(WINDOW)]
        for d, g, p, r in zip(doc[of[left]].tolist(), digest[of[left]].tolist(), (start[of[left]] + within[left]).tolist(), numbers):
            places[d, g, r.tobytes()].append(p)
        return spans, [(d, g, at, b" ".join([words[i] for i in np.frombuffer(r, np.int32).tolist()])) for (d, g, r), at in places.items()]


PLACES = pa.list_(pa.int32())


def span_batch(doc, digest, first, last) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(digest, pa.int64()), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.nulls(len(doc), PLACES), pa.nulls(len(doc), pa.binary())], names=["doc", "digest", "first", "last", "places", "window"])


def rows_of(docs: DataFrame, key: str, text: str, own: bool = False) -> DataFrame:
    """(doc, digest, text), and the id as it is: the digest tells rows apart that share an id."""
    body = F.coalesce(F.col(text), F.lit(""))
    given = [F.col(key).alias("id")] if own else []
    return docs.select(*given, F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(body).alias("digest"), body.alias("text"))


def minimiser_sizes(rows: DataFrame) -> DataFrame:
    """(minimiser, windows) that would travel; the row without a minimiser has all windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_parts(batch.column("text"), PIECE):
                ids, digests = (batch.column(c).to_pylist()[part] for c in ("doc", "digest"))
                for r in runs(ids, digests, texts):
                    go = r.travelling()
                    values, at = np.unique(r.least[go], return_inverse=True)
                    sizes = np.bincount(at, r.count[go]).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([*values.view(np.int64).tolist(), None], pa.int64()), pa.array([*sizes.tolist(), int(r.count.sum())])], names=["minimiser", "windows"])

    return rows.mapInArrow(released(run), "minimiser long, windows long").groupBy("minimiser").agg(F.sum("windows").alias("windows"))


def shares(rows: DataFrame, sample: int = SAMPLE, hot_windows: int = HOT_WINDOWS, fewest: int = BUCKETS) -> tuple[int, int, np.ndarray, np.ndarray]:
    """The numbers of buckets and tasks, the hot minimisers (at most two a bucket), sorted, and the buckets each of them gets. Plan only."""
    sizes = stored(minimiser_sizes(rows.filter(F.pmod(F.xxhash64("doc", F.lit(7)), F.lit(sample)) == 0)), "minimisers")
    total = (sizes.filter("minimiser IS NULL").agg(F.sum("windows")).first()[0] or 0) * sample
    buckets = max(fewest, -(-total // BUCKET_WINDOWS))
    bucket = max(hot_windows, total // buckets)
    found = sizes.filter(F.col("minimiser").isNotNull() & (F.col("windows") * sample > bucket / 2)).collect()
    hot = sorted((np.array([r["minimiser"]]).view(np.uint64)[0], -(-2 * r["windows"] * sample // bucket)) for r in found)
    return buckets, tasks_for(rows, total, buckets), np.array([m for m, _ in hot], np.uint64), np.array([n for _, n in hot], np.uint64)


def tasks_for(rows: DataFrame, windows: int, most: int) -> int:
    return min(most, max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-windows // TASK_WINDOWS)))


def to_buckets(rows: DataFrame, buckets: int, hot: np.ndarray, parts: np.ndarray) -> DataFrame:
    """(bucket, decided, blob): the packed strings for each bucket, a blob a chunk, and the spans that a chunk decides itself."""
    most = min(PIECE, max(1 << 20, buckets << 14))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_parts(batch.column("text"), 2 * most):
                ids, digests = (batch.column(c).to_pylist()[part] for c in ("doc", "digest"))
                for r in runs(ids, digests, texts, most):
                    go = r.travelling()
                    at = np.searchsorted(hot, r.least)
                    is_hot = (at < len(hot)) & (np.append(hot, np.uint64(0))[at] == r.least)
                    salt = np.zeros(len(at), np.uint64)
                    salt[is_hot] = mix(r.doc[is_hot].view(np.uint64) ^ r.digest[is_hot].view(np.uint64)) % parts[at[is_hot]] + np.uint64(1)
                    bucket = (mix(r.least + salt * _B) % np.uint64(buckets)).astype(np.int32)
                    out = []
                    order = np.flatnonzero(go)[np.argsort(bucket[go], kind="stable")]
                    for some in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []:
                        out.append((int(bucket[some[0]]), False, r.packed(some, is_hot)))
                    if not go.all():
                        gone = np.flatnonzero(~go)
                        doc, digest, first, last = r.doc[gone], r.digest[gone], r.start[gone], r.start[gone] + r.count[gone] + np.int32(WINDOW - 1)
                        cut = np.r_[True, (digest[1:] != digest[:-1]) | (doc[1:] != doc[:-1]) | (first[1:] > last[:-1]) | (first[1:] < first[:-1])]
                        ends = np.r_[np.flatnonzero(cut)[1:], len(gone)] - 1
                        out.append((int(bucket[gone[0]]), True, pack([doc[cut], digest[cut], first[cut], last[ends]], b"")))
                    yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int32(), pa.bool_(), pa.binary()))], names=["bucket", "decided", "blob"])

    return rows.mapInArrow(released(run), "bucket int, decided boolean, blob binary")


def in_buckets(packed: DataFrame, tasks: int) -> DataFrame:
    """Spans, and rows with a window for what a hot minimiser's bucket could not decide alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, windows = None, Windows()

        def finish():
            if windows.parts:
                spans, left = windows.decided()
                yield spans
                if left:
                    doc, digest, at, strings = zip(*left)
                    none = pa.nulls(len(left), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(digest, pa.int64()), none, none, pa.array(at, PLACES), pa.array(strings, pa.binary())], names=["doc", "digest", "first", "last", "places", "window"])

        for batch in batches:
            for bucket, done, blob in zip(batch.column("bucket").to_pylist(), batch.column("decided").to_pylist(), batch.column("blob")):
                if bucket != now:
                    yield from finish()
                    now, windows = bucket, Windows()
                if done:
                    yield span_batch(*unpack(blob.as_py(), SPAN)[0])
                else:
                    arrays, text = unpack(blob.as_py(), RUN)
                    windows.add_text(arrays, text)
        yield from finish()

    dealt = packed.repartition(tasks, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(released(run), f"{SPANS}, places array<int>, window binary")


def by_window(left: DataFrame, buckets: int, tasks: int) -> DataFrame:
    """Spans of single windows that several buckets left; equal windows meet by their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, windows, places = None, Windows(), []

        def finish():
            if windows.parts:
                found = windows.decided()[0]  # its first word is the number of the row here
                rows = [(d, g, p) for d, g, i in zip(*(found.column(c).to_pylist() for c in ("doc", "digest", "first"))) for p in places[i]]
                doc, digest, first = (np.array(c, np.int64) for c in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 3
                yield span_batch(doc, digest, first, first + WINDOW).select(["doc", "digest", "first", "last"])

        for batch in batches:
            bucket = batch.column("bucket").to_numpy()
            for some in np.split(np.arange(len(bucket)), np.flatnonzero(np.diff(bucket)) + 1):
                if bucket[some[0]] != now:
                    yield from finish()
                    now, windows, places = bucket[some[0]], Windows(), []
                mine = batch.slice(int(some[0]), len(some))
                number = np.arange(len(places), len(places) + len(some), dtype=np.int32)
                places += mine.column("places").to_pylist()
                text = b" ".join(mine.column("window").to_pylist())
                # A row for each window: runs of one window never join, so each span names one row.
                windows.add_text([mine.column("doc").to_numpy(), mine.column("digest").to_numpy(), number, np.ones(len(some), np.int32), np.zeros(len(some), bool)], text)
        yield from finish()

    dealt = left.withColumn("bucket", F.pmod(F.xxhash64("window"), F.lit(buckets)).cast("int")).repartition(tasks, "bucket").sortWithinPartitions("bucket")
    return dealt.select("bucket", "doc", "digest", "places", "window").mapInArrow(released(run), SPANS)


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", **plan) -> DataFrame:
    """(doc, digest, first, last): word ranges [first, last) that windows of smaller documents cover; ranges may touch or overlap."""
    rows = rows_of(docs, key, text)
    buckets, tasks, hot, parts = shares(rows, **plan)
    found = stored(in_buckets(to_buckets(rows, buckets, hot, parts), tasks), "repeats")
    spans = found.filter("window IS NULL").drop("places", "window")
    if len(hot):
        left = found.filter("window IS NOT NULL")
        n = left.count()
        again = max(buckets, -(-n // BUCKET_WINDOWS))
        spans = spans.unionByName(by_window(left, again, tasks_for(rows, n, again)))
    return spans.distinct()


def compressed(rows: DataFrame) -> DataFrame:
    """rows with their texts as compressed bytes, `body`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_parts(batch.column("text"), PIECE):
                body = pa.array([pack([np.zeros(0)], t) for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(part.start, len(texts)) for c in ("id", "doc", "digest")), body], names=["id", "doc", "digest", "body"])

    return rows.mapInArrow(released(run), f"id {rows.schema['id'].dataType.simpleString()}, doc long, digest long, body binary")


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", **plan) -> DataFrame:
    """(key, n_words, n_removed, spans, kept): removed word ranges in order, not touching, and the words that stay, joined by one space."""
    marks = repeated_spans(docs, key, text, **plan).groupBy("doc", "digest").agg(F.collect_list(F.struct("first", "last")).alias("marks"))
    rows = rows_of(docs, key, text, own=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, bodies in text_parts(batch.column("body"), PIECE // 2):
                ids = batch.column("id").slice(part.start, len(bodies))
                out = []
                for body, mark in zip(bodies, batch.column("marks").slice(part.start, len(bodies))):
                    words = unpack(body, [])[1].split()
                    ranges, kept, at = [], [], 0
                    for a, b in sorted((m["first"], m["last"]) for m in mark.as_py() or ()):
                        if ranges and a <= ranges[-1]["last"]:
                            ranges[-1]["last"] = max(b, ranges[-1]["last"])
                        else:
                            ranges.append({"first": a, "last": b})
                    for r in ranges:
                        kept += words[at : r["first"]]
                        at = r["last"]
                    kept += words[at:]
                    out.append((len(words), len(words) - len(kept), ranges, b" ".join(kept)))
                shape = (pa.int64(), pa.int64(), pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([o[i] for o in out], t) for i, t in enumerate(shape)), pa.array([o[3] for o in out], pa.binary()).cast(pa.string())], names=[key, "n_words", "n_removed", "spans", "kept"])

    joined = compressed(rows).join(marks, ["doc", "digest"], "left").select("id", "body", "marks")
    kind = docs.schema[key].dataType.simpleString()
    return joined.mapInArrow(released(run), f"`{key}` {kind}, n_words long, n_removed long, spans array<struct<first:int,last:int>>, kept string")


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words that windows of smaller documents cover."""
    found = without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = f"""WITH ws AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{SPACE_WORD}') AS w FROM documents),
wins AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM ws)),
hits AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS m FROM wins) WHERE m < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM hits),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM ws) a WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = a.doc_id AND g.p = a.p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM ws LEFT JOIN kept USING (doc_id)"""
