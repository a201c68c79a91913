"""Language-model scores: context-tree weighting over bytes, beside smoothed word counts.

The tree. Each byte is eight binary decisions; a decision's contexts are the bytes before it, 0 to DEPTH of them. Every
node estimates by Krichevsky-Trofimov, and a context's weighted probability is half its own estimate and half the product
of its children's, so that all depths are mixed. Texts start after START bytes and end with an END byte, neither of which
UTF-8 has. Score and code length are of the text with A-Z lower-cased.

How it is spread. A key is a byte and the DEPTH bytes before it, nearest first.

1. Each task's texts form chunks; a chunk's distinct keys, with their training counts, go to buckets by their nearest ROOT
   bytes, so that a bucket has whole subtrees. Its words (as 64-bit hashes) go to buckets of their own.
2. A bucket weights its subtrees bottom-up, depth by depth, and keeps for each key the eight mixtures below depth ROOT.
   The sums of its subtrees go to the nodes above, grouped by the nearest byte.
3. These groups (256 at most) weight the depths between the root and ROOT; the root itself is one row of 255 nodes.
4. With what lies above, each bucket gives every chunk the code lengths of its keys, and a chunk sums them by document.

A frequent key costs one entry for each chunk that has it, not one for each place. Nothing but the root's 255 nodes is on
the driver or broadcast, and the number of nodes grows with the input.

Defined cases: null text is empty: its only token is the end; without training texts all counts are 0; rows that repeat an id
are scored each; an empty table stays empty; other columns are ignored; a very long text is a chunk of its own, whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.bytewords import LOWER, hash_words, mix
from quire.llm.common import crc_mod, released, stored, table, text_parts

#: Bytes of context, 7 at most, and of those the nearest by which keys are dealt to buckets (2 above a bucket are weighted in step 3).
DEPTH, ROOT = 5, 3
START, END = 0xFE, 0xFF
END_HASH = np.uint64(0x5851F42D4C957F2D)
SMOOTHING = 0.1
#: Text bytes of a chunk and of a bucket, and the least number of buckets.
CHUNK, BUCKET, BUCKETS = 6 << 20, 16 << 20, 64
HALF = np.log(0.5)


# ---------------------------------------------------------------- context tree


def keys_of(texts: list[bytes], depth: int = DEPTH) -> np.ndarray:
    """A key for every byte of every text and its end, texts one after the other: the byte in the lowest eight bits, then
    the bytes before it, the nearest highest."""
    sizes = np.array([len(t) + depth + 1 for t in texts])
    pad = bytes([START]) * depth
    data = LOWER[np.frombuffer(b"".join(pad + t + bytes([END]) for t in texts), np.uint8)]
    keys = data[depth:].astype(np.uint64)
    for back in range(1, depth + 1):
        one = data[depth - back : len(data) - back].astype(np.uint64)
        one <<= np.uint64(8 * (depth - back + 1))
        keys |= one
    own = np.ones(len(data), bool)
    own[((np.cumsum(sizes) - sizes)[:, None] + np.arange(depth)).ravel()] = False
    return keys[own[depth:]]


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, for x beyond the tables."""
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3)


_HALVES, _WHOLES = (np.array([math.lgamma(n + more) for n in range(4096)]) for more in (0.5, 1.0))


def _gamma_at(n: np.ndarray, known: np.ndarray, more: float) -> np.ndarray:
    found = known[np.minimum(n, len(known) - 1)]
    far = n >= len(known)
    if far.any():
        found[far] = log_gamma(n[far] + more)
    return found


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability of so many zeros and ones under the Krichevsky-Trofimov estimate."""
    return _gamma_at(zeros, _HALVES, 0.5) + _gamma_at(ones, _HALVES, 0.5) - _gamma_at(zeros + ones, _WHOLES, 1.0) - np.log(np.pi)


def weighted(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes with children: log weighted probability, weight of the own estimate, and its probability of a one."""
    own = log_kt(zeros, ones) + HALF
    log = np.logaddexp(own, below + HALF)
    return log, np.exp(own - log), (ones + 0.5) / (zeros + ones + 1)


def decision(byte: np.ndarray, level: int) -> np.ndarray:
    """The inner node (1 to 255; node k has children 2k and 2k + 1) at which a byte's bit of this level is decided."""
    return 1 << level | byte >> (8 - level)


def subtrees(keys: np.ndarray, n: np.ndarray, depth: int, root: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Sorted distinct keys and their counts -> for each key and level the mixture of the depths from `root` down; and
    the nodes just above (context and decision) with their zeros, ones and the sum of their children's logarithms.

    Depths go from the deepest up. pairs are (context, byte) of a depth, place tells each key's pair, and log has the
    weighted logarithms of the depth below, by level.
    """
    pairs, count, place = keys, n, np.arange(len(keys))
    mixed, log, first, to = np.zeros((len(keys), 8)), [], [], None
    for d in range(depth, root - 1, -1):
        byte, now, starts = (pairs & 255).astype(np.int64), [], []
        above: list[tuple] = []
        for level in range(8):
            k = decision(byte, level)
            node = pairs >> 8 << 8 | k.astype(np.uint64)
            new = np.append(True, node[1:] != node[:-1])
            start = np.flatnonzero(new)
            run = np.cumsum(new) - 1
            total, ones = np.add.reduceat(count, start), np.add.reduceat(count * (byte >> (7 - level) & 1), start)
            if d == depth:
                here, p = log_kt(total - ones, ones), (ones + 0.5) / (total + 1)
                mixed[:, level] = p[run]
            else:
                here, w, p = weighted(total - ones, ones, np.bincount(run[to[first[level]]], log[level], len(start)))
                mine = run[place]
                mixed[:, level] = w[mine] * p[mine] + (1 - w[mine]) * mixed[:, level]
            now.append(here)
            starts.append(start)
            above.append((node[start] >> 16 << 8 | node[start] & 255, total - ones, ones, here))
        log, first = now, starts
        if d > root:
            pairs, to = np.unique(pairs >> 16 << 8 | pairs & 255, return_inverse=True)
            count, place = np.bincount(to, count, len(pairs)).astype(np.int64), to[place]
    return mixed, summed_nodes(*(np.concatenate(x) for x in zip(*above)))


def summed_nodes(node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, log: np.ndarray) -> dict[str, np.ndarray]:
    found, which = np.unique(node, return_inverse=True)
    whole = lambda x: np.bincount(which, x, len(found)).astype(np.int64)
    return {"node": found.astype("<u8"), "zeros": whole(zeros).astype("<i8"), "ones": whole(ones).astype("<i8"), "log": np.bincount(which, log, len(found)).astype("<f8")}


# ---------------------------------------------------------------- rows of numbers


def squeeze(values: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed: planes of sorted numbers' differences hold little."""
    planes = np.frombuffer(values.tobytes(), np.uint8).reshape(len(values), values.itemsize).T
    return len(values).to_bytes(4, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unsqueeze(raw: bytes, kind: str) -> np.ndarray:
    n, size = int.from_bytes(raw[:4], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(raw[4:], n * size, "zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.frombuffer(planes.T.tobytes(), kind)


def squeeze_text(text: bytes) -> bytes:
    return len(text).to_bytes(8, "little") + pa.compress(text, "zstd", asbytes=True)


def unsqueeze_text(raw: bytes) -> bytes:
    return pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), "zstd", asbytes=True)


def fold(p: np.ndarray) -> bytes:
    """Probabilities in single precision: those over a half as what they lack to one, negative, so that it keeps its precision."""
    return np.where(p <= 0.5, p, p - 1).astype("<f4").tobytes()


def unfold(raw: bytes) -> np.ndarray:
    x = np.frombuffer(raw, "<f4").astype(float)
    return np.where(x >= 0, x, 1 + x)


def squeeze_sorted(values: np.ndarray) -> bytes:
    return squeeze(np.diff(values, prepend=np.uint64(0)).astype("<u8"))


def unsqueeze_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(raw, "<u8"), dtype=np.uint64)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of hashes."""
    return ((hashes >> np.uint64(32)).astype(np.int64) * buckets) >> 32


def key_order(keys: np.ndarray, buckets: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys -> an order by bucket that keeps them sorted within one, and where each bucket starts and ends."""
    bucket = bucket_of(mix(keys >> np.uint64(8 * (depth - ROOT + 1))), buckets)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


# ---------------------------------------------------------------- chunks

_ENTRY = "chunk long, bucket int, words boolean, a binary, b binary"


def _chunk_rows(chunk: int, keys: pa.Array, held: np.ndarray, texts: list[bytes], buckets: int, depth: int) -> Iterator[pa.RecordBatch]:
    """A row with the chunk's documents and texts, and a row per bucket with its distinct words or keys."""
    rows: list[tuple] = []

    def entries(found: np.ndarray, train: np.ndarray, cut: np.ndarray, words: bool) -> None:
        for b in np.flatnonzero(np.diff(cut)).tolist():
            mine = slice(cut[b], cut[b + 1])
            rows.append((b, words, squeeze_sorted(found[mine]), squeeze(train[mine].astype("<u4"))))

    hashes, counts = tokens_of(texts)
    found, order, codes = distinct(hashes)
    train = np.bincount(codes[np.repeat(~held, counts)], minlength=len(found))[order]
    entries(found, train, np.searchsorted(bucket_of(found, buckets), np.arange(buckets + 1)), True)

    found, order, codes = distinct(keys_of(texts, depth))
    sizes = np.array([len(t) + 1 for t in texts])
    train = np.bincount(codes[np.repeat(~held, sizes)], minlength=len(found))[order]
    sort, cut = key_order(found, buckets, depth)
    entries(found[sort], train[sort], cut, False)

    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    lists = [one(keys), one(pa.array(held)), one(pa.array(sizes - 1, pa.int64()))]
    names = ["chunk", "bucket", "words", "a", "b", "doc_ids", "held", "n_bytes"]
    first = [pa.array([chunk], pa.int64()), pa.array([-1], pa.int32()), pa.array([None], pa.bool_()), pa.array([squeeze_text(b"".join(texts))], pa.binary()), pa.array([None], pa.binary()), *lists]
    yield pa.RecordBatch.from_arrays(first, names)
    bucket, words, a, b = zip(*rows)
    many = [pa.array([chunk] * len(rows), pa.int64()), pa.array(bucket, pa.int32()), pa.array(words), pa.array(a, pa.binary()), pa.array(b, pa.binary())]
    yield pa.RecordBatch.from_arrays([*many, *(pa.nulls(len(rows), x.type) for x in lists)], names)


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and ends, one text after the other, and how many each text has."""
    hashes, counts = hash_words(texts)
    return np.insert(hashes, np.cumsum(counts), END_HASH), counts + 1


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys; their order of appearance (found = appeared[order]); and each key's number by appearance."""
    codes, appeared = pd.factorize(keys)
    order = np.argsort(appeared)
    return appeared[order], order, codes


def _chunks(batches: Iterator[pa.RecordBatch], buckets: int, chunk_bytes: int, depth: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    chunk = TaskContext.get().partitionId() << 32
    keys, helds, texts, size = [], [], [], 0

    def flush():
        return _chunk_rows(chunk, pa.concat_arrays(keys), np.array(pa.concat_arrays(helds).to_pylist(), bool), texts, buckets, depth)

    for batch in batches:
        for part, mine in text_parts(batch.column(2), min(1 << 20, chunk_bytes)):
            more = sum(map(len, mine))
            if texts and size + more > chunk_bytes:
                yield from flush()
                chunk, size = chunk + 1, 0
                keys, helds, texts = [], [], []
            keys.append(batch.column(0).slice(part.start, part.stop - part.start))
            helds.append(batch.column(1).slice(part.start, part.stop - part.start))
            texts += mine
            size += more
    if texts:
        yield from flush()


# ---------------------------------------------------------------- buckets


def _binaries(t: pa.Table, name: str) -> list[bytes]:
    return t.column(name).to_pylist()


def _word_totals(t: pa.Table) -> pa.Table:
    """One bucket of words: each chunk's words get their counts over all chunks. n and v are the bucket's, on its first row."""
    hashes = [unsqueeze_sorted(x) for x in _binaries(t, "a")]
    counts = [unsqueeze(x, "<u4") for x in _binaries(t, "b")]
    found, which = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(which, np.concatenate(counts), minlength=len(found)).astype(np.int64)
    per = np.split(total[which], np.cumsum([len(h) for h in hashes])[:-1])
    rest = [0] * (len(per) - 1)
    return pa.table(
        {
            "chunk": t.column("chunk"),
            "bucket": t.column("bucket"),
            "values": pa.array([squeeze(p.astype("<i8")) for p in per], pa.binary()),
            "n": pa.array([int(total.sum()), *rest], pa.int64()),
            "v": pa.array([int((total > 0).sum()), *rest], pa.int64()),
        }
    )


_NODES = "bucket int, nearest int, a binary, b binary"


def _subtree_rows(t: pa.Table, depth: int) -> pa.Table:
    """One bucket of keys: a row (nearest null) with its keys and their mixtures, and a row for each nearest byte with the nodes above."""
    keys = np.concatenate([unsqueeze_sorted(x) for x in _binaries(t, "a")])
    found, which = np.unique(keys, return_inverse=True)
    n = np.bincount(which, np.concatenate([unsqueeze(x, "<u4") for x in _binaries(t, "b")]), len(found)).astype(np.int64)
    mixed, above = subtrees(found, n, depth, ROOT)
    nearest = (above["node"] >> np.uint64(8 * (ROOT - 1))).astype(np.int64)
    cut = np.append(np.flatnonzero(np.diff(nearest, prepend=-1)), len(nearest))
    parts = [slice(a, z) for a, z in zip(cut, cut[1:])]
    numbers = [np.stack([above["zeros"][p], above["ones"][p], above["log"][p].view("<i8")]).tobytes() for p in parts]
    bucket = t.column("bucket")[0].as_py()
    return pa.table(
        {
            "bucket": pa.array([bucket] * (len(parts) + 1), pa.int32()),
            "nearest": pa.array([None, *(int(nearest[p.start]) for p in parts)], pa.int32()),
            "a": pa.array([squeeze_sorted(found), *(squeeze_sorted(above["node"][p]) for p in parts)], pa.binary()),
            "b": pa.array([fold(mixed), *numbers], pa.binary()),
        }
    )


def _middle_rows(t: pa.Table) -> pa.Table:
    """Nodes of one nearest byte: each bucket's nodes get (own, rest) so that own + rest * mixture below is the mixture from
    depth 1 down; a row (bucket null) has the 256 decisions' zeros, ones and logarithms at depth 1."""
    nodes = [unsqueeze_sorted(x) for x in _binaries(t, "a")]
    numbers = [np.frombuffer(x, "<i8").reshape(3, -1) for x in _binaries(t, "b")]
    zeros, ones, log = np.concatenate(numbers, axis=1)
    all_ = summed_nodes(np.concatenate(nodes), zeros, ones, log.view("<f8"))
    log2, w2, p2 = weighted(all_["zeros"], all_["ones"], all_["log"])
    k = (all_["node"] & np.uint64(255)).astype(np.int64)
    over = lambda x: np.bincount(k, x, 256)
    zeros1, ones1 = over(all_["zeros"]).astype(np.int64), over(all_["ones"]).astype(np.int64)
    log1, w1, p1 = weighted(zeros1, ones1, over(log2))
    own, rest = w1[k] * p1[k] + (1 - w1[k]) * w2 * p2, (1 - w1[k]) * (1 - w2)
    both = np.stack([own, rest])
    give = [both[:, np.searchsorted(all_["node"], x)].astype("<f8").tobytes() for x in nodes]
    top = np.stack([zeros1, ones1, log1.view("<i8")]).tobytes()
    return pa.table(
        {
            "bucket": pa.array([None, *t.column("bucket").to_pylist()], pa.int32()),
            "nearest": pa.array([t.column("nearest")[0].as_py()] * (len(nodes) + 1), pa.int32()),
            "a": pa.array([b"", *_binaries(t, "a")], pa.binary()),
            "b": pa.array([top, *give], pa.binary()),
        }
    )


def root_of(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Depth 1 of all nearest bytes (256 at most) -> weight and probability of the 256 decisions at the root."""
    zeros, ones, log = np.zeros(256, np.int64), np.zeros(256, np.int64), np.zeros(256)
    for x in rows:
        z, o, g = np.frombuffer(x, "<i8").reshape(3, 256)
        zeros, ones, log = zeros + z, ones + o, log + g.view("<f8")
    return weighted(zeros, ones, log)[1:]


def _bucket_bits(t: pa.Table, depth: int, w0: np.ndarray, p0: np.ndarray) -> pa.Table:
    """One bucket: its model's rows (chunk null) and the chunks' keys -> the code length of each chunk's keys, in bits."""
    chunk, nearest = t.column("chunk").to_pylist(), t.column("nearest").to_pylist()
    a, b = _binaries(t, "a"), _binaries(t, "b")
    model = next(i for i, c in enumerate(chunk) if c is None and nearest[i] is None)
    keys, mixed = unsqueeze_sorted(a[model]), unfold(b[model]).reshape(-1, 8)
    above = sorted((nearest[i], i) for i, c in enumerate(chunk) if c is None and nearest[i] is not None)
    nodes = np.concatenate([unsqueeze_sorted(a[i]) for _, i in above])
    own, rest = np.concatenate([np.frombuffer(b[i], "<f8").reshape(2, -1) for _, i in above], axis=1)
    context, byte, bits = keys >> np.uint64(8 * (depth - ROOT + 2)) << np.uint64(8), (keys & np.uint64(255)).astype(np.int64), np.zeros(len(keys))
    for level in range(8):
        k = decision(byte, level)
        at = np.searchsorted(nodes, context | k.astype(np.uint64))
        one = w0[k] * p0[k] + (1 - w0[k]) * (own[at] + rest[at] * mixed[:, level])
        bits -= np.log2(np.where(byte >> (7 - level) & 1, one, 1 - one))
    bits = bits.astype("<f4")
    asked = [i for i, c in enumerate(chunk) if c is not None]
    return pa.table(
        {
            "chunk": pa.array([chunk[i] for i in asked], pa.int64()),
            "bucket": pa.array([t.column("bucket")[0].as_py()] * len(asked), pa.int32()),
            "values": pa.array([squeeze(bits[np.searchsorted(keys, unsqueeze_sorted(a[i]))]) for i in asked], pa.binary()),
        }
    )


# ---------------------------------------------------------------- scores


def _chunk_scores(batch: pa.RecordBatch, i: int, buckets: int, depth: int, n: int, v: int) -> pa.RecordBatch:
    get = lambda name: batch.column(name)[i]
    parts = get("parts").as_py()
    sizes = np.array(get("n_bytes").as_py(), np.int64)
    data, ends = unsqueeze_text(get("a").as_py()), np.cumsum(sizes).tolist()
    texts = [data[z - s : z] for s, z in zip(sizes.tolist(), ends)]

    hashes, tokens = tokens_of(texts)
    found, order, codes = distinct(hashes)
    counts = np.empty(len(found), np.int64)
    counts[order] = np.concatenate([unsqueeze(p["values"], "<i8") for p in parts if p["words"]])
    first = np.cumsum(tokens) - tokens
    logs = np.log10((counts + SMOOTHING) / (n + SMOOTHING * (v + 1)))
    known, base = np.add.reduceat((counts > 0).astype(np.int64)[codes], first), np.add.reduceat(logs[codes], first)

    found, order, codes = distinct(keys_of(texts, depth))
    sort, _ = key_order(found, buckets, depth)
    bits = np.empty(len(found))
    bits[order[sort]] = np.concatenate([unsqueeze(p["values"], "<f4") for p in parts if not p["words"]])
    total = np.add.reduceat(bits[codes], np.cumsum(sizes + 1) - sizes - 1)
    made = [tokens, known, np.full(len(first), n, np.int64), base, total * -np.log10(2.0), total / (sizes + 1)]
    return pa.RecordBatch.from_arrays([get(name).values for name in ("doc_ids", "held")] + [pa.array(x) for x in made], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])


def scores(docs: DataFrame, chunk_bytes: int = CHUNK, depth: int = DEPTH) -> DataFrame:
    """(doc_id, held_out, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte; learns from
    rows that aren't held out."""
    if not ROOT < depth <= 7:
        raise ValueError(f"depth is over {ROOT} and at most 7")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(BUCKETS, -(-size // BUCKET))
    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"{_ENTRY}, doc_ids array<{kind}>, held array<boolean>, n_bytes array<bigint>"
    chunks = stored(docs.select("doc_id", "held_out", "text").mapInArrow(released(lambda it: _chunks(it, buckets, chunk_bytes, depth)), shape), "lm-chunks")
    entries = chunks.filter("bucket >= 0").select("chunk", "bucket", "words", "a", "b")
    asked = entries.filter("not words").select("chunk", "bucket", "a", "b")

    totals = stored(entries.filter("words").groupBy("bucket").applyInArrow(_word_totals, "chunk long, bucket int, values binary, n long, v long"), "lm-counts")
    n, v = (x or 0 for x in totals.agg(F.sum("n"), F.sum("v")).first())

    low = stored(asked.groupBy("bucket").applyInArrow(lambda t: _subtree_rows(t, depth), _NODES), "lm-subtrees")
    middle = stored(low.filter("nearest is not null").groupBy("nearest").applyInArrow(_middle_rows, _NODES), "lm-middle")
    w0, p0 = root_of([bytes(r["b"]) for r in middle.filter("bucket is null").select("b").collect()])  # at most 256 rows of 256 numbers
    model = low.filter("nearest is null").unionByName(middle.filter("bucket is not null")).withColumn("chunk", F.lit(None).cast("long"))
    both = model.unionByName(asked.withColumn("nearest", F.lit(None).cast("int")))
    bits = both.groupBy("bucket").applyInArrow(lambda t: _bucket_bits(t, depth, w0, p0), "chunk long, bucket int, values binary")

    given = totals.select("chunk", "bucket", "values", F.lit(True).alias("words")).unionByName(bits.withColumn("words", F.lit(False)))
    per_chunk = given.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("words", "bucket", "values"))).alias("parts"))
    rows = chunks.filter("bucket < 0").select("chunk", "doc_ids", "held", "n_bytes", "a").join(per_chunk, "chunk")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield _chunk_scores(batch, i, buckets, depth, n, v)

    return rows.mapInArrow(released(run), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", (crc_mod(F.col("doc_id"), 10) == 0).alias("held_out"), "text")
    return scores(docs)
