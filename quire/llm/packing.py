"""Best-fit packing of token sequences by linear grouping.

Only the number of pieces of each length matters for the plan, and lengths are 1 to `capacity`: that histogram (at most
`capacity` rows, whatever the input) is planned on the driver.

1. Pieces longer than capacity / SMALL are large. Sorted by length they form GROUPS groups of equal size; within a
   group every length is rounded up to the group's longest.
2. Configurations (how many pieces of each rounded length a sequence holds) are optimised by linear programming over
   the few rounded lengths, columns being generated by a knapsack.
3. Every configuration is used as often as its amount's whole part says, and the groups' actual pieces take its places.
   The pieces that the fractions leave over, and the small ones, go best-fit, longest first, into what is left.

The plan is a list of runs: so many sequences alike. Pieces are numbered within their length (a count per task and a
running sum over tasks, so no task sees all pieces of a length) and look their place up by length and number.

Defined cases: null text is empty and becomes one piece with the end token alone; rows that repeat an id are documents of
their own; an empty table gives no rows; other columns are ignored; very long texts are cut into pieces of `capacity`; among
sequences with equally much left, the one that came last takes a piece first.
"""

from __future__ import annotations

import base64
import json
import os
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import released, stored, table, text_parts

CAPACITY = 1024
END_TOKEN = 2
SMALL = 4  # `configurations` rests on it
#: With so many groups rounding costs about 0.1 % (0.3 % where all lengths are equally frequent).
GROUPS = 384
AT_ONCE = 2 << 20
#: Up to so many tasks their counts (16 bytes a length) are broadcast, else pieces move to their task's counts.
BROADCAST_TASKS = 2048


# ---------------------------------------------------------------- tokens


class Words:
    """Token ids of texts as little-endian 32-bit numbers.

    Whole texts are encoded at once: where words are many and most are rare, that takes a third of the time of looking them up.
    `ids` takes the names of added tokens as plain text; `with_added` gives their own ids, as the JSON file does.
    """

    def __init__(self, vocabulary: str | None = None):
        import public_tokenizers as public
        import tiktoken

        path = vocabulary or public.path("byte_bpe_50k.tiktoken")
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        beside = os.path.splitext(path)[0] + ".json"
        self.added = {}
        if os.path.exists(beside):
            with open(beside, encoding="utf-8") as f:
                self.added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        self.encoding = tiktoken.Encoding("words", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens=self.added)

    def plain(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        return self.encoding.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()

    def with_added(self, text: str) -> bytes:
        if any(name in text for name in self.added):
            return self.encoding.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()
        return self.ids(text)


_WORDS: dict[str | None, Words] = {}


def words(vocabulary: str | None = None) -> Words:
    if vocabulary not in _WORDS:
        _WORDS[vocabulary] = Words(vocabulary)
    return _WORDS[vocabulary]


def _pieces(batches: Iterator[pa.RecordBatch], capacity: int, vocabulary: str | None) -> Iterator[pa.RecordBatch]:
    """Token pieces; the first piece of a document takes what is over a multiple of the capacity."""
    from pyspark import TaskContext

    encode, task, seen = words(vocabulary).with_added, TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
    end = END_TOKEN.to_bytes(4, "little")
    for batch in batches:
        keys = batch.column(0)
        rows: list[list] = [[], [], [], [], [], []]

        def flush(rows=rows, keys=keys):
            at, piece, start, length, number, ids = rows
            out = pa.RecordBatch.from_arrays(
                [keys.take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32())]
                + [pa.array([task] * len(at), pa.int32()), pa.array(number, pa.int64()), pa.array(ids, pa.binary())],
                ["doc_id", "piece", "start", "length", "task", "number", "ids"],
            )
            for r in rows:
                r.clear()
            return out

        held = 0
        for i, text in ((part.start + k, t) for part, texts in text_parts(batch.column(1), AT_ONCE, as_bytes=False) for k, t in enumerate(texts)):
            ids = encode(text or "") + end
            n = len(ids) // 4
            cut, piece = n % capacity or capacity, 0
            start = 0
            while start < n:
                stop = cut + piece * capacity
                size = stop - start
                for r, v in zip(rows, (i, piece, start, size, int(seen[size]), ids[4 * start : 4 * stop])):
                    r.append(v)
                seen[size] += 1
                start, piece = stop, piece + 1
            held += len(ids)
            if held > 8 << 20:
                held = 0
                yield flush()
        if rows[0]:
            yield flush()


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, text) -> pieces (doc_id, piece, start, length, task, number, ids); number counts pieces of that length in the task."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, piece int, start long, length int, task int, number long, ids binary"
    return docs.select("doc_id", "text").mapInArrow(released(lambda batches: _pieces(batches, capacity, vocabulary)), shape)


# ---------------------------------------------------------------- plan


class _Bins:
    """Sequences in classes: what is left -> list of [how many, contents as (length, times) pairs]."""

    def __init__(self, capacity: int):
        self.capacity, self.classes = capacity, defaultdict(list)

    def add(self, count: int, contents: tuple, left: int) -> None:
        if count:
            self.classes[left].append([count, contents])

    def best_fit(self, length: int, count: int) -> None:
        """Each piece goes where the least is left; once in, a sequence takes more of them as long as they fit."""
        for left in sorted(x for x, runs in self.classes.items() if x >= length and runs):
            fits = left // length
            while count and self.classes[left]:
                run = self.classes[left][-1]
                whole = min(run[0], count // fits)
                if whole:
                    run[0] -= whole
                    self.add(whole, run[1] + ((length, fits),), left - fits * length)
                    count -= whole * fits
                elif count:
                    run[0] -= 1
                    self.add(1, run[1] + ((length, count),), left - count * length)
                    count = 0
                if not run[0]:
                    self.classes[left].remove(run)
            if not count:
                return
        fits = self.capacity // length
        self.add(count // fits, ((length, fits),), self.capacity - fits * length)
        if count % fits:
            self.add(1, ((length, count % fits),), self.capacity - count % fits * length)


def groups_of(sizes: list[tuple[int, int]], groups: int) -> list[list[tuple[int, int]]]:
    """(length, count), longest first -> lists of the same with about equal numbers of pieces."""
    total = sum(c for _, c in sizes)
    out, left = [], [list(x) for x in sizes]
    for g in range(groups):
        room, mine = total * (g + 1) // groups - total * g // groups, []
        while room:
            take = min(room, left[0][1])
            mine.append((left[0][0], take))
            room -= take
            left[0][1] -= take
            if not left[0][1]:
                left.pop(0)
        if mine:
            out.append(mine)
    return out


def configurations(lengths: list[int], counts: list[int], capacity: int) -> list[tuple[np.ndarray, float]]:
    """Fewest sequences for counts of few lengths, in fractions: (pieces of each length, how many such sequences).

    Starts from sequences of one length each; a knapsack over the dual prices finds the column that enters. Lengths are
    over a quarter of the capacity, so a column has three pieces at most: every pair, and the dearest third that fits.
    """
    m = len(lengths)
    base = [np.eye(m)[i] * (capacity // lengths[i]) for i in range(m)]
    need = np.array(counts, float)
    inverse = np.diag(1.0 / np.array([c.sum() for c in base]))  # of the basis; a column's change updates it
    times = lambda vector: (inverse * vector).sum(axis=1)
    order = np.argsort(lengths, kind="stable")
    sizes = np.append(np.array(lengths)[order], 0)  # the last stands for no piece
    first, second = np.triu_indices(m + 1)
    room = capacity - sizes[first] - sizes[second]
    first, second, room = (x[room >= 0] for x in (first, second, room))
    fits = np.searchsorted(sizes[:m], room, side="right")  # how many lengths the third piece may have
    fuller = 1e-6 * (capacity - room) / capacity  # of columns that are worth the same, the fullest enters
    for _ in range(60 * m):
        amounts, prices = times(need), np.append(inverse.sum(axis=0)[order], 0.0)
        dearest = np.maximum.accumulate(np.append(0.0, prices[:m]))
        value = prices[first] + prices[second] + dearest[fits]
        best = int((value + fuller).argmax())
        if value[best] <= 1 + 1e-5:
            break
        column = np.zeros(m + 1)
        third = int(prices[: fits[best]].argmax()) if dearest[fits[best]] > 0 else m
        np.add.at(column, [first[best], second[best], third], 1)
        placed = np.zeros(m)
        placed[order] = column[:m]
        move = times(placed)
        ratios = np.where(move > 1e-9, amounts / np.where(move > 1e-9, move, 1), np.inf)
        out = int(ratios.argmin())
        base[out] = placed
        pivot = inverse[out] / move[out]
        inverse -= np.outer(move, pivot)
        inverse[out] = pivot
    return [(c.astype(int), max(0.0, a)) for c, a in zip(base, times(need))]


def configured(histogram: dict[int, int], capacity: int, groups: int) -> tuple[list[tuple[int, tuple, int]], dict[int, int]]:
    """Sequences made by configurations (how many, contents, what is left), and the pieces left over by length."""
    made: list[tuple[int, tuple, int]] = []
    sizes = sorted(((n, c) for n, c in histogram.items() if 0 < n < capacity and c), reverse=True)
    large = [(n, c) for n, c in sizes if n > capacity // SMALL]
    rest: dict[int, int] = defaultdict(int, {n: c for n, c in sizes if n <= capacity // SMALL})
    parts = groups_of(large, min(groups, sum(c for _, c in large))) if large else []
    merged: dict[int, list] = {}
    for part in parts:  # groups of one rounded length are one
        merged.setdefault(part[0][0], []).extend(part)
    rounded, actual = list(merged), [[list(x) for x in part] for part in merged.values()]
    if not rounded:
        return made, rest
    for column, amount in configurations(rounded, [sum(c for _, c in a) for a in actual], capacity):
        slots = [g for g in range(len(rounded)) for _ in range(column[g])]
        number = min([int(amount + 1e-6), *(sum(c for _, c in actual[g]) // column[g] for g in set(slots))])
        while number > 0:  # as many sequences at once as take the same actual lengths
            contents: dict[int, int] = defaultdict(int)
            take: dict[tuple[int, int], int] = defaultdict(int)
            for g in set(slots):
                want = int(column[g])
                for j, (n, c) in enumerate(actual[g]):
                    now = min(want, c)
                    if now:
                        contents[n] += now
                        take[g, j] += now
                        want -= now
                    if not want:
                        break
            run = min([number, *(actual[g][j][1] // t for (g, j), t in take.items())])
            for (g, j), t in take.items():
                actual[g][j][1] -= run * t
            made.append((run, tuple(contents.items()), capacity - sum(n * t for n, t in contents.items())))
            number -= run
            for g in set(slots):
                actual[g] = [x for x in actual[g] if x[1]]
    for part in actual:
        for n, c in part:
            rest[n] += c
    return made, rest


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[int, tuple]]:
    """Length -> count becomes runs (how many sequences, their contents as (length, times) pairs)."""
    made, rest = configured(histogram, capacity, groups)
    bins = _Bins(capacity)
    bins.add(histogram.get(capacity, 0), ((capacity, 1),), 0)
    for count, contents, left in made:
        bins.add(count, contents, left)
    for n in sorted(rest, reverse=True):
        if rest[n]:
            bins.best_fit(n, rest[n])
    return [(count, contents) for runs in bins.classes.values() for count, contents in runs if count]


def places(runs: list[tuple[int, tuple]]) -> list[tuple[int, int, int, int, int, int]]:
    """Runs -> (length, first number, number after the last, first sequence, pieces a sequence, offset), for each length in each run."""
    used: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for count, contents in runs:
        offset = 0
        for length, times in contents:
            out.append((length, used[length], used[length] + count * times, sequence, times, offset))
            used[length] += count * times
            offset += length * times
        sequence += count
    return out


def numbered(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row per task with how many pieces of each length stand in tasks before it; and (length, task, n) counts.

    The running sum is over one row per task and length.
    """
    counts = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    listed = counts.select("task", F.struct("length", before.alias("before")).alias("entry"))
    return listed.groupBy("task").agg(F.map_from_entries(F.collect_list("entry")).alias("before")), counts


def pack(docs: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, text) -> doc_id, piece, start, length, ids, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = stored(token_pieces(docs, capacity, vocabulary), "pack-pieces")
    before, counts = numbered(pieces)
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    shape = "length int, runs array<struct<first:bigint,after:bigint,sequence:bigint,times:bigint,offset:bigint>>"
    by_length: dict[int, list] = defaultdict(list)
    for length, *place in places(plan(histogram, capacity, groups)):
        by_length[length].append(tuple(place))
    runs = spark.createDataFrame(list(by_length.items()), shape)
    few = counts.agg(F.max("task")).first()[0] or 0  # a row of at most `capacity` numbers for each task
    located = pieces.join(F.broadcast(before) if few < BROADCAST_TASKS else before, "task")
    mine = located.withColumn("rank", F.element_at("before", F.col("length")) + F.col("number")).join(F.broadcast(runs), "length")
    run = F.get(F.filter("runs", lambda r: (r["first"] <= F.col("rank")) & (F.col("rank") < r["after"])), F.lit(0))
    return (
        mine.withColumn("run", run)
        .withColumn("within", F.col("rank") - F.col("run.first"))
        .select(
            "doc_id",
            "piece",
            "start",
            F.col("length").cast("long").alias("length"),
            "ids",
            (F.col("run.sequence") + F.expr("within div run.times")).alias("sequence_id"),
            (F.col("run.offset") + F.expr("within % run.times") * F.col("length")).alias("offset"),
        )
    )


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
