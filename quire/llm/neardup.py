"""Near-duplicate vectors by cross-polytope hashing.

A vector is turned by three rounds of random signs and a fast Hadamard transform; its hash is the largest coordinate and
its sign. A table's bucket joins `hashes` such hashes (as many as keep buckets small); besides its own bucket a vector goes to
the `probes` - 1 buckets that it misses least. Vectors that share a bucket are compared by cosine in double precision, in
blocks where a bucket is large; pairs are counted in the least bucket they share and never leave the task: it returns, for
each vector, how many it links with and the least member of what it reaches there.

The number of hashes grows with the largest label, and tables and probes grow with it (`index_shape`), so that the share of
links found stays the same at every size: above 0.99 at the threshold for up to 4 hashes (tested).

Copies (equal vectors of one label) are one class with a count. Links need equal labels that aren't null.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite numbers link with nothing, as do those with a
null label; vectors of different lengths don't link; rows that repeat an id are vectors of their own; a null id takes the
component's least id (null if there is none); an empty table stays empty; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import released, schema_of, stored, table
from quire.llm.graph import block_pairs, components

COSINE = 0.93
TABLES, PROBES = 6, 3  # of one or two hashes; more in `index_shape`
#: Vectors in a bucket that a table's number of hashes aims at, and in a block of a large bucket.
BUCKET, BLOCK = 64, 512
#: Rows that a task call compares (its groups together), and the largest group that is compared row distance by row distance.
BIN, SMALL = 8192, 48
SEED = 5


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, scaled to keep lengths; the length is a power of two."""
    n, h = x.shape[1], 1
    x = x.copy()
    while h < n:
        x = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        h *= 2
        x = x.reshape(len(x), n)
    return x / math.sqrt(n)


def bucket_keys(unit: np.ndarray, hashes: int, tables: int = TABLES, probes: int = PROBES, seed: int = SEED) -> np.ndarray:
    """Unit vectors -> keys[vector, tables * probes]; the key names its table too."""
    n, d = unit.shape
    width = 1 << max(1, (d - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :d] = unit
    out = np.zeros((n, tables, probes), np.int64)
    at = np.arange(n)
    for t in range(tables):
        best, second, loss = (np.zeros((n, hashes), kind) for kind in (np.int64, np.int64, float))
        for k in range(hashes):
            signs = np.random.default_rng([seed, width, t, k]).choice([-1.0, 1.0], (3, width))
            x = padded
            for s in signs:
                x = hadamard(x * s)
            size = np.abs(x)
            i = size.argmax(axis=1)
            top = size[at, i]
            size[at, i] = -1
            j = size.argmax(axis=1)
            best[:, k], second[:, k] = 2 * i + (x[at, i] < 0), 2 * j + (x[at, j] < 0)
            loss[:, k] = top - size[at, j]
        order = np.argsort(loss, axis=1)
        for p in range(probes):  # own bucket; then the one with the most doubtful hash changed, the next one, both, ...
            code = best.copy()
            for k in range(hashes):
                if p >> k & 1:
                    code[at, order[:, k]] = second[at, order[:, k]]
            key = np.full(n, t + 1, np.uint64)
            for k in range(hashes):
                key = (key ^ code[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
            out[:, t, p] = key.astype(np.int64)
    return out.reshape(n, -1)


def index_shape(hashes: int) -> tuple[int, int]:
    """Tables and probes that find a pair as surely with many hashes as with one."""
    return max(TABLES, 4 * hashes - 4), max(PROBES, 2 * hashes - 2)


def _vectors(column) -> list[np.ndarray | None]:
    """Usable vectors in double precision, else None."""
    out = []
    for v in column.to_pylist():
        x = None
        if v and None not in v:
            x = np.array(v, float)
            largest = np.abs(x).max()
            if not np.isfinite(x).all() or not largest > 0:
                x = None
            elif not 1e-140 < largest < 1e140:
                x = x / largest  # squares would over- or underflow
        out.append(x)
    return out


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [x if label is not None else None for x, label in zip(_vectors(batch.column(1)), batch.column(2).to_pylist())]
        keys = [None if x is None else hashlib.blake2b((x + 0.0).tobytes(), digest_size=16).digest() for x in found]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], [*batch.schema.names, "digest"])


def _emit(batches: Iterator[pa.RecordBatch], hashes: int, tables: int, probes: int) -> Iterator[pa.RecordBatch]:
    names = ["cid", "label", "n", "dims", "vector", "keys", "key"]
    for batch in batches:
        for start in range(0, batch.num_rows, 4096):
            part = batch.slice(start, 4096)
            vectors = _vectors(part.column(3))
            for d in sorted({len(v) for v in vectors}):
                rows = np.array([i for i, v in enumerate(vectors) if len(v) == d])
                x = np.stack([vectors[i] for i in rows])
                keys = bucket_keys(x / np.linalg.norm(x, axis=1, keepdims=True), hashes, tables, probes)
                once = [np.unique(k) for k in keys]
                index = np.repeat(np.arange(len(rows)), [len(k) for k in once])
                raw, lists = [v.tobytes() for v in x], [np.sort(k).tobytes() for k in keys]
                take = pa.array(rows[index])
                yield pa.RecordBatch.from_arrays(
                    [part.column(i).take(take) for i in range(3)]
                    + [pa.array(np.full(len(index), d, np.int32)), pa.array([raw[i] for i in index], pa.binary()), pa.array([lists[i] for i in index], pa.binary()), pa.array(np.concatenate(once))],
                    names,
                )


def least_reached(n: int, i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The least id that each of n members reaches by the links (i, j)."""
    reached = ids.copy()
    while True:
        before = reached.copy()
        np.minimum.at(reached, i, before[j])
        np.minimum.at(reached, j, before[i])
        if (reached == before).all():
            return reached


def _pairs_here(x: np.ndarray, norms: np.ndarray, cosine: float, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near pairs within the groups of one bin: small groups by the distance of their rows, large ones by matrix products."""
    small = sizes <= SMALL
    rows = np.flatnonzero(small[np.repeat(np.arange(len(sizes)), sizes)])
    left = (np.repeat(starts + sizes, sizes) - np.arange(len(x)))[rows]
    for k in range(1, int(sizes[small].max()) if small.any() else 0):
        i = rows[left > k]
        near = np.einsum("ij,ij->i", x[i], x[i + k]) >= cosine * norms[i] * norms[i + k]
        yield i[near], i[near] + k
    for g in np.flatnonzero(~small):
        a, z = starts[g], starts[g] + sizes[g]
        for top in range(a, z, 1024):  # bounded pieces of the matrix of products
            end = min(top + 1024, z)
            i, j = np.nonzero(x[top:end] @ x[a:z].T >= cosine * norms[top:end, None] * norms[None, a:z])
            i, j = i + top, j + a
            m = i < j
            yield i[m], j[m]


def _compare(t: pa.Table, cosine: float) -> pa.Table:
    """All pairs of the groups in one bin: for each vector its links that belong here, and the least id it reaches."""
    t = t.sort_by("group")
    group, cid, n, home, block_a, block_b, blocks, key = (t.column(c).to_numpy() for c in ("group", "cid", "n", "home", "block_a", "block_b", "blocks_", "key"))
    keys = np.stack([np.frombuffer(v, np.int64) for v in t.column("keys").to_pylist()])
    dims = t.column("dims").to_numpy()

    def spread(i, j):
        """A pair across two blocks belongs to them; one within a block, to that block with the one after it."""
        a, b, k = block_a[i], block_b[i], blocks[i]
        own = np.where(home[i] == a, b == (a + 1) % k, a == (b + 1) % k)
        return (k == 1) | (home[i] != home[j]) | own

    ids, local = np.unique(cid, return_inverse=True)
    links, firsts, seconds = np.zeros(len(ids)), [np.zeros(0, int)], [np.zeros(0, int)]
    raw = t.column("vector").to_pylist()
    for d in np.unique(dims).tolist():
        mine = np.flatnonzero(dims == d)
        x = np.stack([np.frombuffer(raw[i], float) for i in mine])
        s = np.flatnonzero(np.diff(group[mine], prepend=group[mine[0]] - 1))
        for i, j in _pairs_here(x, np.sqrt((x * x).sum(axis=1)), cosine, s, np.diff(s, append=len(mine))):
            i, j = mine[i], mine[j]
            m = spread(i, j)
            i, j = i[m], j[m]
            firsts.append(local[i])
            seconds.append(local[j])
            for part in np.array_split(np.arange(len(i)), max(1, len(i) // 20_000)):
                shared = (keys[i[part]][:, :, None] == keys[j[part]][:, None, :]).any(axis=2)
                here = np.where(shared, keys[i[part]], np.iinfo(np.int64).max).min(axis=1) == key[i[part]]
                ii, jj = i[part][here], j[part][here]
                links += np.bincount(local[ii], n[jj], len(ids)) + np.bincount(local[jj], n[ii], len(ids))
    i, j = np.concatenate(firsts), np.concatenate(seconds)
    reached = least_reached(len(ids), i, j, ids)
    some = np.zeros(len(ids), bool)
    some[i] = some[j] = True
    return pa.table({"cid": pa.array(ids[some]), "links": pa.array(links[some].astype(np.int64)), "least": pa.array(reached[some])})


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, tables: int | None = None, probes: int | None = None) -> DataFrame:
    """(vec_id, embedding, label) -> vec_id, n_links, component_id."""
    rows = vectors.select("vec_id", "embedding", "label")
    marked = stored(rows.mapInArrow(released(_digests), schema_of(rows, "digest binary")), "near-vectors").withColumn("cid", F.when(F.col("digest").isNotNull(), F.xxhash64("label", "digest")))
    classes = marked.filter("cid is not null").groupBy("cid").agg(F.first("label").alias("label"), F.count(F.lit(1)).alias("n"), F.first("embedding").alias("embedding"))
    classes = stored(classes, "near-classes")
    largest = classes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    hashes = max(1, math.ceil(math.log(max(1, largest) / BUCKET) / math.log(64))) if largest else 1
    usual = index_shape(hashes)
    tables, probes = tables or usual[0], probes or usual[1]
    kind = classes.schema["label"].dataType.simpleString()
    shape = f"cid long, label {kind}, n long, dims int, vector binary, keys binary, key long"
    emitted = classes.select("cid", "label", "n", "embedding").mapInArrow(released(lambda it: _emit(it, hashes, tables, probes)), shape)
    group = ["label", "dims", "key"]
    dealt = block_pairs(stored(emitted, "near-buckets"), group, "cid", BLOCK).withColumn("group", F.xxhash64(*group, "block_a", "block_b"))
    bins = max(1, math.ceil(classes.count() * tables * probes / BIN))
    binned = dealt.withColumn("bin", F.pmod(F.hash("group"), F.lit(bins))).select("bin", "group", "cid", "n", "dims", "vector", "keys", "key", "home", "block_a", "block_b", "blocks_")
    found = stored(binned.groupBy("bin").applyInArrow(lambda t: _compare(t, cosine), "cid long, links long, least long"), "near-links")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("cid").alias("a"), F.col("least").alias("b"))).withColumnRenamed("node", "cid")
    known = classes.select("cid", "n").join(links, "cid", "left").join(joined, "cid", "left").select("cid", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "cid").alias("component"))
    known = stored(known, "near-known")
    placed = marked.select("vec_id", "cid").join(known, "cid", "left")
    # Written first, so that the join stands alone and a large component's rows can be split among tasks.
    least = stored(placed.filter("component is not null").groupBy("component").agg(F.min("vec_id").alias("least_id")), "near-least")
    return placed.join(least, "component", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("component").isNull(), F.col("vec_id")).otherwise(F.col("least_id")).alias("component_id"))


def op5_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
