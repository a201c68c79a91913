"""N-gram Jaccard join: documents whose sets of word 5-grams have a Jaccard similarity of at least 0.8.

A set is the distinct 64-bit hashes of a text's 5-word runs (a shorter text's words as one). Documents with equal sets
are one class.

1. Order. How often each n-gram occurs is estimated by a count-min sketch over all documents (two rows of 2^18
   counters, whatever the input; an estimate is never too low). All documents order their n-grams by estimate, then
   hash: rare ones first. Any total order gives right results; this one keeps common n-grams out of the prefixes.
2. Prefixes. Two similar sets share an n-gram among the first n - ceil(0.8 n) + 1 of each. These n-grams go to buckets by
   hash; those that only one class has are dropped there. Very frequent ones (by their estimate) are dealt by class instead.
3. Stars. Of the classes that share an n-gram, each is paired with one of them, and pairs that pass the length,
   positional and suffix filters are verified by the whole sets, once each.
4. The rest. Where classes that share an n-gram are still in different components, all pairs between those components
   that pass the filters are verified too. A pair within a component needs no test: it could not change a component.
   The positional filter counts, before the common n-gram, only those that two components share.

So components are exact, and a group of many near copies costs a multiple of its size, not of its square.

Defined cases: null and empty texts, and texts without words, have no n-grams and link with nothing; their component is
their own id; rows that repeat an id are documents of their own; null ids give way to other ids of the component; an
empty table stays empty; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from quire.llm.bytewords import hash_words, mix
from quire.llm.common import released, stored, table, text_parts
from quire.llm.graph import block_pairs, components

WORDS = 5
#: Jaccard similarity in percent.
PERCENT = 80
SKETCH_ROWS, SKETCH_BITS = 2, 18
#: Estimated occurrences from which an n-gram's entries are dealt by class.
FREQUENT = 50_000
#: Entries in a bucket; classes that share an n-gram and meet in one task; rows of a task call.
BUCKET, BLOCK, BIN = 500_000, 512, 8192
#: How many n-grams before a common one are looked at for an earlier meeting of a pair.
EARLIER = 4
#: Hash ranges of the suffix filter.
RANGES = 64
#: Representatives' ids are broadcast up to so many (8 bytes each), else joined by shuffling.
BROADCAST_IDS = 1_000_000
AT_ONCE = 1 << 20
_FACTORS = np.random.default_rng(99).integers(1, 1 << 62, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sets_of(texts: list[bytes]) -> list[np.ndarray]:
    """Each text's sorted distinct n-gram hashes."""
    hashes, counts = hash_words(texts)
    runs = max(0, len(hashes) - WORDS + 1)
    grams = np.zeros(runs, np.uint64)
    for k in range(WORDS):
        grams += hashes[k : k + runs] * _FACTORS[k]
    grams = mix(grams)
    out, at = [], 0
    for n in counts.tolist():
        if n >= WORDS:
            out.append(np.unique(grams[at : at + n - WORDS + 1]))
        elif n:
            out.append(mix(np.array([(hashes[at : at + n] * _FACTORS[:n]).sum() + np.uint64(n)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def class_id(grams: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


def ranges_of(grams: np.ndarray) -> np.ndarray:
    """How many n-grams lie in each of RANGES ranges of hashes."""
    return np.bincount((grams >> np.uint64(58)).astype(np.int64), minlength=RANGES)


def sketch_slots(grams: np.ndarray) -> list[np.ndarray]:
    mask = np.uint64((1 << SKETCH_BITS) - 1)
    return [((grams >> np.uint64(SKETCH_BITS * r)) & mask).astype(np.int64) for r in range(SKETCH_ROWS)]


def _describe(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows: id, set size, class, ranges; and at the end the task's part of the sketch, in pieces of 4096 counters."""
    from pyspark import TaskContext

    sketch = np.zeros((SKETCH_ROWS, 1 << SKETCH_BITS), np.int64)
    key_type = None
    for batch in batches:
        key_type = batch.schema.field(0).type
        for part, texts in text_parts(batch.column(1), AT_ONCE):
            sets = sets_of(texts)
            every = np.concatenate(sets)
            for row, slots in zip(sketch, sketch_slots(every)):
                row += np.bincount(slots, minlength=1 << SKETCH_BITS)
            n = len(sets)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(part.start, n),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([class_id(s) if len(s) else None for s in sets], pa.int64()),
                    pa.array([np.minimum(ranges_of(s), 0xFFFF).astype("<u2").tobytes() for s in sets], pa.binary()),
                    pa.nulls(n, pa.int32()),
                    pa.nulls(n, pa.int32()),
                    pa.nulls(n, pa.binary()),
                ],
                names,
            )
    if key_type is not None:
        pieces = sketch.reshape(-1, 4096)
        some = np.flatnonzero(pieces.any(axis=1))
        n = len(some)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(n, key_type), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(some, pa.int32()), pa.array([TaskContext.get().partitionId()] * n, pa.int32()), pa.array([pieces[i].astype("<i8").tobytes() for i in some], pa.binary())],
            names,
        )


def _sum_pieces(t: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), "<i8") for x in t.column("counters"))
    return pa.table({"piece": t.column("piece")[:1].cast(pa.int32()), "salt": t.column("salt")[:1].cast(pa.int32()), "counters": pa.array([total.tobytes()], pa.binary())})


def describe(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, text) -> (doc_id, n, cid, ranges), and the sketch of all n-grams."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n", "cid", "ranges", "piece", "salt", "counters"]
    shape = f"doc_id {kind}, n long, cid long, ranges binary, piece int, salt int, counters binary"
    both = stored(docs.select("doc_id", "text").mapInArrow(released(lambda it: _describe(it, names)), shape), "gram-classes")
    parts = both.filter("piece is not null").select("piece", "salt", "counters")
    for width in (512, 1 << 30):  # tasks' parts are summed by 512, then those sums
        parts = parts.withColumn("salt", F.expr(f"salt div {width}").cast("int")).groupBy("piece", "salt").applyInArrow(_sum_pieces, "piece int, salt int, counters binary")
    sketch = np.zeros((SKETCH_ROWS, 1 << SKETCH_BITS), np.int64).reshape(-1, 4096)
    for r in parts.collect():  # at most SKETCH_ROWS * 2^SKETCH_BITS counters
        sketch[r["piece"]] = np.frombuffer(r["counters"], "<i8")
    return both.filter("piece is null").select("doc_id", "n", "cid", "ranges"), sketch.reshape(SKETCH_ROWS, -1)


def in_order(grams: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams rare first, and their estimates."""
    estimate = np.minimum.reduce([row[s] for row, s in zip(sketch, sketch_slots(grams))])
    order = np.lexsort((grams, estimate))
    return grams[order], estimate[order]


def prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


def _entries(batches: Iterator[pa.RecordBatch], sketch: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Prefix entries as one row a bucket: hashes, classes, set sizes, places. A class is written once in a task's memory."""
    seen: set[int] = set()
    held: list[list[np.ndarray]] = [[], [], [], [], []]
    size = 0

    def flush():
        bucket, grams, cids, n, at = (np.concatenate(x) for x in held)
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        cut = np.append(np.flatnonzero(np.diff(bucket, prepend=bucket[0] - 1)), len(bucket))
        raw = [[x[order][a:z].tobytes() for a, z in zip(cut, cut[1:])] for x in (grams, cids, n, at)]
        for x in held:
            x.clear()
        return pa.RecordBatch.from_arrays([pa.array(bucket[cut[:-1]], pa.int32()), *[pa.array(x, pa.binary()) for x in raw]], ["bucket", "grams", "cids", "n", "at"])

    for batch in batches:
        for _, texts in text_parts(batch.column(0), AT_ONCE):
            for grams in sets_of(texts):
                n = len(grams)
                if not n:
                    continue
                cid = class_id(grams)
                if cid in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(cid)
                sorted_, estimate = in_order(grams, sketch)
                k = prefix_length(n)
                g = sorted_[:k]
                bucket = ((g >> np.uint64(32)).astype(np.int64) * buckets) >> 32
                frequent = estimate[:k] >= FREQUENT
                bucket[frequent] = -1 - cid % buckets
                for x, v in zip(held, (bucket, g, np.full(k, cid), np.full(k, n, np.int32), np.arange(k, dtype=np.int32))):
                    x.append(v)
                size += k
            if size > 200_000:
                yield flush()
                size = 0
    if size:
        yield flush()


def _shared(t: pa.Table) -> pa.Table:
    """A bucket's entries whose n-gram more than one class has (all entries in a bucket of frequent n-grams), each once."""
    grams, cids, n, at = (np.concatenate([np.frombuffer(x.as_py(), kind) for x in t.column(c)]) for c, kind in (("grams", "<u8"), ("cids", "<i8"), ("n", "<i4"), ("at", "<i4")))
    order = np.lexsort((cids, grams))
    grams, cids, n, at = grams[order], cids[order], n[order], at[order]
    new = np.append(True, (grams[1:] != grams[:-1]) | (cids[1:] != cids[:-1]))
    grams, cids, n, at = grams[new], cids[new], n[new], at[new]
    if t.column("bucket")[0].as_py() >= 0:
        same = grams[1:] == grams[:-1]
        many = np.append(same, False) | np.append(False, same)
        grams, cids, n, at = grams[many], cids[many], n[many], at[many]
    return pa.table({"gram": pa.array(grams.astype(np.int64)), "cid": pa.array(cids), "n": pa.array(n), "at": pa.array(at)})


def passes(na, nb, pa_, pb, sa, sb):
    """Length and positional filter for sets of na and nb n-grams with a common one at places pa_ and pb of their order.

    Of what stands before it in either set, only n-grams that could be common count: sa and sb of them. An n-gram before the
    common one that both sets have lies in both prefixes, so one that no other class has in its prefix is not common.
    """
    least = lambda a, b: F.least(a, b) if hasattr(a, "alias") else np.minimum(a, b)
    most = least(sa, sb) + 1 + least(na - pa_ - 1, nb - pb - 1)
    return (100 * least(na, nb) >= PERCENT * na) & (100 * least(na, nb) >= PERCENT * nb) & ((100 + PERCENT) * most >= PERCENT * (na + nb))


def with_before(entries: DataFrame) -> DataFrame:
    """Adds before: how many of the class's entries stand before this one (a window over one class's prefix)."""
    return entries.withColumn("before", F.row_number().over(W.partitionBy("cid").orderBy("at")) - 1)


def with_earlier(entries: DataFrame) -> DataFrame:
    """Adds earlier: the class's last EARLIER entries before this one (0 where there are fewer)."""
    line = W.partitionBy("cid").orderBy("at")
    return entries.withColumns({f"earlier_{k}": F.lag("gram", k, 0).over(line) for k in range(1, EARLIER + 1)})


def _between(t: pa.Table) -> pa.Table:
    """Pairs of classes of different components that share an n-gram and pass the filters; a bin holds whole groups.

    Where both classes have the same n-gram among their last few before this one, the pair met there already: if it
    failed a filter there, it is not similar, and if it passed, it was given.
    """
    t = t.sort_by([("group", "ascending"), ("component", "ascending")])
    group, cid, component, n, at, before, home, a, b, blocks = (t.column(c).to_numpy() for c in ("group", "cid", "component", "n", "at", "before", "home", "block_a", "block_b", "blocks_"))
    n, at, before = n.astype(np.int64), at.astype(np.int64), before.astype(np.int64)
    earlier = [t.column(f"earlier_{k}").to_numpy() for k in range(1, EARLIER + 1)]
    starts = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
    firsts, seconds = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s, z in zip(starts, np.append(starts[1:], len(group))):
        if component[s] == component[z - 1]:
            continue
        for i in range(s, z):  # the components after this row's one
            j = np.arange(i + np.searchsorted(component[i:z], component[i], side="right"), z)
            if not len(j):
                break
            own = np.where(home[i] == a[i], b[i] == (a[i] + 1) % blocks[i], a[i] == (b[i] + 1) % blocks[i])
            ok = passes(n[i], n[j], at[i], at[j], before[i], before[j]) & ((home[j] != home[i]) | own | (blocks[i] == 1))
            j = j[ok]
            if not len(j):
                continue
            met = np.zeros(len(j), bool)
            for x in earlier:
                if x[i]:
                    for y in earlier:
                        met |= y[j] == x[i]
            j = j[~met]
            firsts.append(np.minimum(cid[i], cid[j]))
            seconds.append(np.maximum(cid[i], cid[j]))
    pairs = np.unique(np.stack([np.concatenate(firsts), np.concatenate(seconds)], axis=1), axis=0)
    return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})


def _suffix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffix filter: what two sets can share is bounded by what they can share in each range of hashes."""
    for batch in batches:
        ra, rb = (np.array([np.frombuffer(x, "<u2") for x in batch.column(c).to_pylist()], np.int64).reshape(-1, RANGES) for c in (4, 5))
        na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        capped = ((ra == 0xFFFF) | (rb == 0xFFFF)).any(axis=1)
        ok = capped | ((100 + PERCENT) * np.minimum(ra, rb).sum(axis=1) >= PERCENT * (na + nb))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok))


def _needed_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, texts in text_parts(batch.column(0), AT_ONCE):
            sets = [s for s in sets_of(texts) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([class_id(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["cid", "grams"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = (np.frombuffer(s.as_py(), "<u8") for s in (x, y))
            both = len(x) + len(y) - len(np.union1d(x, y))
            keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def verified(pairs: DataFrame, docs: DataFrame, described: DataFrame, label: str) -> DataFrame:
    """Those of the pairs (a, b) of classes whose similarity is high enough, by their whole sets."""
    classes = described.filter("cid is not null").groupBy("cid").agg(F.first("n").alias("n"), F.first("ranges").alias("ranges"), F.min("doc_id").alias("doc_id"))
    side = lambda x: classes.select(F.col("cid").alias(x), F.col("n").alias(f"n{x}"), F.col("ranges").alias(f"r{x}"))
    close = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ra", "rb").mapInArrow(released(_suffix), "a long, b long")
    close = stored(close, f"gram-pairs-{label}")
    ids = close.select(F.col("a").alias("cid")).unionByName(close.select(F.col("b").alias("cid"))).distinct()
    ids = stored(classes.join(ids, "cid").select(F.col("doc_id").alias("id_")).distinct(), f"gram-ids-{label}")
    few = ids.count() <= BROADCAST_IDS
    mine = docs.join(F.broadcast(ids) if few else ids, F.col("doc_id").eqNullSafe(F.col("id_")), "left_semi")
    sets = stored(mine.select("text").mapInArrow(released(_needed_sets), "cid long, grams binary").dropDuplicates(["cid"]), f"gram-sets-{label}")
    side = lambda x: sets.select(F.col("cid").alias(x), F.col("grams").alias(f"g{x}"))
    return stored(close.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ga", "gb").mapInArrow(released(_verify), "a long, b long"), f"gram-links-{label}")


def similar(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, n_shingles, component_id, cid (null without n-grams)."""
    docs = docs.select("doc_id", "text")
    described, sketch = describe(docs)
    n = described.agg(F.sum("n")).first()[0] or 0
    buckets = max(64, -(-n // (5 * BUCKET)))
    entries = docs.select("text").mapInArrow(released(lambda it: _entries(it, sketch, buckets)), "bucket int, grams binary, cids binary, n binary, at binary")
    shared = stored(entries.groupBy("bucket").applyInArrow(_shared, "gram long, cid long, n int, at int"), "gram-shared")

    placed = stored(with_before(shared), "gram-placed")
    # The centre is the class with fewest n-grams of its own before this one: an original rather than one of its changed copies.
    star = placed.groupBy("gram").agg(F.min(F.struct((F.col("at") - F.col("before")).alias("own"), F.col("cid"), F.col("n"), F.col("at"), F.col("before"))).alias("c"))
    paired = placed.join(star, "gram").filter((F.col("cid") != F.col("c.cid")) & passes(F.col("n"), F.col("c.n"), F.col("at"), F.col("c.at"), F.col("before"), F.col("c.before")))
    pairs = paired.select(F.least("cid", "c.cid").alias("a"), F.greatest("cid", "c.cid").alias("b")).distinct()
    pairs = stored(pairs, "gram-stars")
    links = verified(pairs, docs, described, "stars")

    joined = components(links)
    known = shared.join(joined.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    mixed = known.groupBy("gram").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least <> most").select("gram")
    rest = block_pairs(stored(with_earlier(with_before(known.join(mixed, "gram"))), "gram-mixed"), ["gram"], "cid", BLOCK).withColumn("group", F.xxhash64("gram", "block_a", "block_b"))
    bins = max(1, -(-(n // 5) // (8 * BIN)))
    binned = rest.withColumn("bin", F.pmod(F.hash("group"), F.lit(bins))).select("bin", "group", "cid", "component", "n", "at", "before", *[f"earlier_{k}" for k in range(1, EARLIER + 1)], "home", "block_a", "block_b", "blocks_")
    more = binned.groupBy("bin").applyInArrow(_between, "a long, b long").distinct()
    more = stored(more.join(pairs, ["a", "b"], "left_anti"), "gram-rest")
    if not more.isEmpty():
        joined = components(links.unionByName(verified(more, docs, described, "rest")))
    placed = described.join(joined.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    # Written first, so that the join stands alone and a large component's rows can be split among tasks.
    least = stored(placed.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("least_id")), "gram-least")
    return placed.join(least, "component", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("least_id")).alias("component_id"), "cid")


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without all but one document of each component: the one with the least (doc_id, MD5 of the text, other columns), null ids first.

    Documents without n-grams all stay. Columns stay as they are.
    """
    key = F.struct(F.col("doc_id").alias("id"), F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("digest"))
    found = similar(docs.select(key.alias("doc_id"), "text"))
    keyed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row_"), key.alias("key_"))
    kept = found.filter(F.col("doc_id") == F.col("component_id")).groupBy(F.col("doc_id").alias("kept_")).agg(F.max("n_shingles").alias("n_"))
    mine = keyed.join(kept, F.col("key_") == F.col("kept_"))
    # Rows of one id and text differ in their other columns only; the least of those stays, whatever order they came in.
    others = [F.col("row_")[f.name] for f in docs.schema.fields if f.name not in ("doc_id", "text")]
    plain = [F.to_json(F.struct(c)) if isinstance(f.dataType, (ArrayType, MapType, StructType)) else c for c, f in zip(others, [f for f in docs.schema.fields if f.name not in ("doc_id", "text")])]
    first = F.row_number().over(W.partitionBy("key_").orderBy(*plain or [F.lit(0)]))
    return mine.withColumn("first_", first).filter("first_ = 1 or n_ = 0").select(*[F.col("row_")[c].alias(c) for c in docs.columns])
