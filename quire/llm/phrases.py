"""Phrase collocations by Toivonen mining: exact counts of all frequent phrases without counting all phrases.

A sample of the documents proposes words and pairs of words. A full pass counts what they propose, with triples of two proposed pairs,
and the negative border: all other words, and all other pairs of proposed words. The border is counted by 64-bit keys of its phrases,
which is never too low. What reaches the support there is a failure: the next pass counts it exactly and goes on from it, until there is no
failure left. Then every frequent phrase has its exact count, whatever the sample was and wherever keys collide.

Proposals reach the tasks as bitmaps of their keys. A bitmap has FILTER_BITS bits at most, however many proposals there are; a
false hit only makes a pass count more than it had to. Each chunk of text adds up its own phrases before anything moves.

Defined cases: a null language is `und`, a null text is empty. Empty texts have no words. Very long texts are cut between words, and
phrases across a cut are counted once. An empty table gives no rows. Columns other than language, text and the id that the sample
is drawn by are not read; rows that repeat an id count each.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.bytewords import hash_words, mix
from quire.llm.common import released, stored, table, text_parts

LONGEST, SUPPORT, MOST, COVER = 3, 10, 2000, 50
#: One document in SAMPLE proposes what it has SAMPLE_SUPPORT times; the lower these are, the fewer failures and the larger the border.
SAMPLE, SAMPLE_SUPPORT = 4, 2
FILTER_BITS, SEGMENT = 1 << 28, 1 << 16
#: Bytes of text that a chunk adds up, that become tokens at once, and for which there is a range of keys.
CHUNK, PART, RANGE_BYTES = 10 << 20, 2 << 20, 24 << 20
#: Candidates that one task ranks.
RANKED = 20_000
# Marks that end a piece.
MARKS = b".,;:!?\n\v\f\r"
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + MARKS, b"abcdefghijklmnopqrstuvwxyz " + b"\n" * len(MARKS))
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def tokens_of(body: bytes) -> list[bytes]:
    """Words, and a line end for each end of a piece."""
    return [w for w in body.translate(_TABLE).replace(b"\n", b" \n ").split(b" ") if w]


def token_chunks(texts: list[bytes], most: int) -> Iterator[tuple[list[bytes], int]]:
    """(tokens, carried): texts as one list with piece ends between them; a text of over `most` bytes in parts, each of which begins
    with the last tokens of the one before, `carried` of them, which are counted there."""
    small = [t for t in texts if len(t) <= most]
    if small:
        yield tokens_of(b"\n".join(small)), 0
    for text in (t for t in texts if len(t) > most):
        at, tail = 0, []
        while at < len(text):
            end = min(len(text), at + most)
            while end < len(text) and text[end] not in b" \t" + MARKS:
                end += 1
            tokens = tail + tokens_of(text[at:end])
            yield tokens, len(tail)
            at, tail = end, tokens[-(LONGEST - 1) :]


def language_hash(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


def word_keys(words: list[bytes], lang: np.ndarray | np.uint64) -> np.ndarray:
    """A hash of each word and its language."""
    return mix(hash_words([b" ".join(words)])[0] * _A + lang) if words else np.zeros(0, np.uint64)


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _A + b * _B + np.uint64(1))


class Members:
    """Bitmaps of proposed words and pairs by their keys; a key is a member if any of them has it."""

    def __init__(self, bitmaps: list[tuple[Broadcast, int]]):
        self.bitmaps = bitmaps

    def __call__(self, keys: np.ndarray, first: int | None = None) -> np.ndarray:
        """Membership by the first bitmaps (default: all)."""
        found = np.zeros(len(keys), bool)
        for bits, hashes in self.bitmaps[:first]:
            data = np.frombuffer(bits.value, np.uint8)
            base, hit = segment_of(keys, 8 * len(data) // SEGMENT) * np.uint64(SEGMENT), np.ones(len(keys), bool)
            for place in offsets(keys, hashes):
                place += base
                hit &= (data[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
            found |= hit
        return found


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    """By the key's leading bits; `segments` is a power of two."""
    return keys >> np.uint64(65 - segments.bit_length()) if segments > 1 else np.zeros(len(keys), np.uint64)


def offsets(keys: np.ndarray, hashes: int) -> Iterator[np.ndarray]:
    for i in range(hashes):
        yield mix(keys + np.uint64(i * int(_B) % (1 << 64))) & np.uint64(SEGMENT - 1)


class Counter:
    """Words of one language in a chunk, as numbers of a vocabulary; 0 ends a piece."""

    def __init__(self, lang: str):
        self.lang, self.size = lang, 0
        self.ids: dict[bytes, int] = defaultdict()
        self.ids.default_factory = self.ids.__len__
        self.ids[b"\n"]
        self.parts: list[np.ndarray] = []
        self.counted: list[np.ndarray] = []

    def add(self, texts: list[bytes], most: int = PART) -> None:
        for tokens, carried in token_chunks(texts, most):
            self.parts += [np.fromiter(map(self.ids.__getitem__, tokens), np.int32, len(tokens)), np.zeros(1, np.int32)]
            self.counted.append(np.arange(len(tokens) + 1) >= carried)
        self.size += sum(map(len, texts))

    def results(self, members: Members | None, done: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.Array | None]]:
        """(length, keys, counts, phrases). Without members: keys of all words and pairs. With them, for each phrase in one pass only:
        the words and pairs that are members by all bitmaps but not by the first `done` ones, and the triples of two member pairs, with
        their phrases; and the border, words in the first pass and pairs of member words, by keys alone. Length 0 counts all words."""
        x, counted = np.concatenate(self.parts).astype(np.int64), np.concatenate(self.counted)
        n = len(self.ids)
        words = pa.array(list(self.ids), pa.binary())
        key = np.concatenate([np.zeros(1, np.uint64), word_keys(list(self.ids)[1:], language_hash(self.lang))])
        each = np.bincount(x[counted], minlength=n)
        each[0] = 0
        pair = np.flatnonzero((x[:-1] > 0) & (x[1:] > 0))
        code, of = np.unique(x[pair] * n + x[pair + 1], return_inverse=True)
        a, b = code // n, code % n
        keys, times = pair_keys(key[a], key[b]), np.bincount(of[counted[pair + 1]], minlength=len(code))
        if members is None:
            yield 1, key[each > 0], each[each > 0], None
            yield 2, keys[times > 0], times[times > 0], None
            return
        now, before = members(key), members(key, done)
        some = np.flatnonzero(now & ~before & (each > 0))
        yield 1, key[some], each[some], words.take(pa.array(some))
        if done == 0:
            yield 0, np.zeros(1, np.uint64), np.array([each.sum()]), pa.array([b""], pa.binary())
            yield 1, key[~now & (each > 0)], each[~now & (each > 0)], None
        border = now[a] & now[b] & ~(before[a] & before[b])
        now, before = members(keys), members(keys, done)
        some = np.flatnonzero(now & ~before & (times > 0))
        yield 2, keys[some], times[some], pc.binary_join_element_wise(words.take(pa.array(a[some])), words.take(pa.array(b[some])), b" ")
        border &= ~now & (times > 0)
        yield 2, keys[border], times[border], None
        at = np.full(len(x), -1, np.int64)
        at[pair] = of
        one, two = at[:-2], at[1:-1]
        whole = (one >= 0) & (two >= 0) & counted[2:]
        one, two = one[whole], two[whole]
        go = now[one] & now[two] & ~(before[one] & before[two])
        code, times = np.unique(one[go] * n + b[two[go]], return_counts=True)
        first, last = code // n, code % n
        yield 3, pair_keys(keys[first], key[last]), times, pc.binary_join_element_wise(words.take(pa.array(a[first])), words.take(pa.array(b[first])), words.take(pa.array(last)), b" ")


def squeezed(body: bytes) -> bytes:
    return len(body).to_bytes(8, "little") + pa.Codec("zstd").compress(body, asbytes=True)


def expanded(blob: bytes) -> bytes:
    return pa.Codec("zstd").decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)


def counts(docs: DataFrame, members: Members | None, done: int, support: int, parts: int) -> DataFrame:
    """(lang, length, phrase, f, key) of what a pass counts and finds at least `support` times, from (lang, text): phrases without key,
    keys of the border without phrase. Counts of a chunk go to `parts` ranges of keys, a blob each; a task adds up a range at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def flush():
            out = []
            for counter in held.values():
                for length, keys, f, phrases in counter.results(members, done):
                    if not len(keys):
                        continue
                    order = np.argsort(keys)
                    keys, f = keys[order], f[order]
                    part = segment_of(keys, parts).astype(np.int64)
                    cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                    listed = phrases.take(pa.array(order)).to_pylist() if phrases is not None else None
                    for start, end in zip(cut.tolist(), [*cut[1:].tolist(), len(keys)]):
                        body = b"\n".join(listed[start:end]) if listed is not None else keys[start:end].tobytes()
                        out.append((int(part[start]), counter.lang, length, listed is not None, end - start, squeezed(f[start:end].astype("<i8").tobytes() + body)))
            held.clear()
            names, kinds = ["part", "lang", "length", "named", "n", "blob"], (pa.int32(), pa.string(), pa.int32(), pa.bool_(), pa.int32(), pa.binary())
            for at in range(0, len(out), 1000):
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out[at : at + 1000]], t) for i, t in enumerate(kinds)], names=names)

        for batch in batches:
            for part, texts in text_parts(batch.column("text"), PART):
                by: dict[str, list[bytes]] = defaultdict(list)
                for lang, text in zip(batch.column("lang").slice(part.start, len(texts)).to_pylist(), texts):
                    by[lang].append(text)
                for lang, mine in by.items():
                    held.setdefault(lang, Counter(lang)).add(mine)
                if sum(c.size for c in held.values()) > CHUNK:
                    yield from flush()
        yield from flush()

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keyed, named = None, [], []

        def finish():
            if keyed:
                keys, f = (np.concatenate(c) for c in zip(*keyed))
                order = np.argsort(keys)
                keys, f = keys[order], f[order]
                first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
                total = np.add.reduceat(f, first)
                go = total >= support
                k = int(go.sum())
                yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.string()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.string()), pa.array(total[go]), pa.array(keys[first][go].view(np.int64))], names=NAMES)
            if named:
                sums = pa.concat_tables(named).group_by(["lang", "length", "phrase"]).aggregate([("f", "sum")])
                sums = sums.filter(pc.or_(pc.greater_equal(sums["f_sum"], support), pc.equal(sums["length"], 0)))
                found = pa.table([sums["lang"], sums["length"], sums["phrase"].cast(pa.string()), sums["f_sum"], pa.nulls(len(sums), pa.int64())], names=NAMES)
                yield from found.combine_chunks().to_batches()

        for batch in batches:
            for part, lang, length, has, n, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "lang", "length", "named", "n", "blob"))):
                if part != now:
                    yield from finish()
                    now, keyed, named = part, [], []
                body = expanded(blob)
                f = np.frombuffer(body, "<i8", n)
                if has:
                    named.append(pa.table({"lang": pa.array([lang] * n, pa.string()), "length": pa.array([length] * n, pa.int32()), "phrase": pa.array(body[8 * n :].split(b"\n"), pa.binary()), "f": f}))
                else:
                    keyed.append((np.frombuffer(body, "<u8", n, 8 * n), f))
        yield from finish()

    packed = docs.mapInArrow(released(run), "part int, lang string, length int, named boolean, n int, blob binary")
    dealt = packed.repartition(parts, "part").sortWithinPartitions("part")
    return dealt.mapInArrow(released(add_up), "lang string, length int, phrase string, f long, key long")


NAMES = ["lang", "length", "phrase", "f", "key"]


def bitmap(keys: DataFrame, n: int) -> tuple[Broadcast, int]:
    """The bitmap of n keys, about 16 bits each up to FILTER_BITS, and its number of hashes.

    A key has all its bits in one segment of 8 KB, chosen by its leading bits. Tasks send offsets by segment; the segments, 32 MB at
    most, go to the driver and are broadcast.
    """
    bits = min(FILTER_BITS, max(SEGMENT, 1 << (16 * n - 1).bit_length()))
    hashes = max(1, min(4, round(0.7 * bits / max(n, 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch.column("key").to_numpy().view(np.uint64) for batch in batches]
        key = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint64)
        segment = segment_of(key, bits // SEGMENT).astype(np.int32)
        cut = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]]) if len(key) else []
        marks = [np.concatenate([o.astype("<u2") for o in offsets(k, hashes)]).tobytes() for k in np.split(key, cut[1:])] if len(key) else []
        yield pa.RecordBatch.from_arrays([pa.array(segment[cut] if len(key) else [], pa.int32()), pa.array(marks, pa.binary())], names=["segment", "part"])

    def merge(group: pa.Table) -> pa.Table:
        marks = np.zeros(SEGMENT, np.uint8)
        marks[np.frombuffer(b"".join(group["part"].to_pylist()), "<u2")] = 1
        return pa.table({"segment": group["segment"][:1], "part": pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())})

    whole = bytearray(bits // 8)
    for r in keys.mapInArrow(released(run), "segment int, part binary").groupBy("segment").applyInArrow(merge, "segment int, part binary").toLocalIterator():
        whole[r["segment"] * SEGMENT // 8 : (r["segment"] + 1) * SEGMENT // 8] = r["part"]
    return keys.sparkSession.sparkContext.broadcast(bytes(whole)), hashes


def frequent_phrases(docs: DataFrame, key: str = "doc_id", lang: str = "lang", text: str = "text", support: int = SUPPORT, sample: int = SAMPLE, sample_support: int = SAMPLE_SUPPORT) -> tuple[DataFrame, int]:
    """(lang, length, phrase, f): every phrase of 1 to 3 words with f >= support, and each language's number of words (length 0);
    and the number of full passes."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.pmod(F.xxhash64(F.col(key)), F.lit(sample)).alias("deal"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 << max(4, (size // RANGE_BYTES).bit_length())
    proposed = counts(rows.filter("deal = 0").drop("deal"), None, 0, sample_support, parts)
    new, rows, found, bitmaps = stored(proposed, "proposed").select("key"), rows.drop("deal"), None, []
    while True:
        n = new.count()
        if n == 0 and found is not None:
            return found, len(bitmaps)
        bitmaps.append(bitmap(new, n))
        now = stored(counts(rows, Members(bitmaps), len(bitmaps) - 1, support, parts), "frequent")
        new, now = now.filter("key IS NOT NULL").select("key"), now.filter("key IS NULL").drop("key")
        found = now if found is None else found.unionByName(now)


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (l r)), exactly: products are decimals of 38 digits."""
    wide = lambda c: c.cast("decimal(18,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (wide(a) * wide(a)).cast("decimal(31,0)"), (wide(left) * wide(right)).cast("decimal(37,0)"))


def collocations(frequent: DataFrame, cover: int = COVER) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of candidates of 2 and 3 words that no longer one covers; the cut is the lowest-scoring one."""
    f = frequent.filter("length > 0").select("lang", "phrase", "f")
    longer = frequent.filter("length >= 2")
    words = F.split("phrase", " ", -1)
    joined = lambda a, n: F.array_join(F.slice("words", a, n), " ")
    cuts = longer.select("lang", "phrase", F.col("f").alias("a"), "length", words.alias("words"), F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "length", "a", "cut", joined(F.lit(1), F.col("cut")).alias("left"), joined(F.col("cut") + 1, F.col("length") - F.col("cut")).alias("right"))
    sides = cuts.join(f.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(f.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    least = sides.groupBy("lang", "phrase").agg(F.min(F.struct(score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "cut", "l", "r")).alias("m"), F.first("a").alias("a"), F.first("length").alias("length"))
    inner = frequent.filter("length = 3").select("lang", "f", words.alias("words")).select("lang", "f", F.explode(F.array(joined(F.lit(1), F.lit(2)), joined(F.lit(2), F.lit(2)))).alias("phrase"))
    over = inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = least.join(over, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("length") == 3) | (F.lit(100) * F.col("longer") < F.lit(cover) * F.col("a")))
    totals = frequent.filter("length = 0").select("lang", F.col("f").alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))
    return kept.join(totals, "lang").select("lang", "phrase", "a", F.col("m.l").alias("l"), F.col("m.r").alias("r"), "n", F.col("m.score").alias("score"))


def ranked(found: DataFrame, most: int = MOST) -> DataFrame:
    """Each language's first `most` rows, with rank; ranked in parts first, and parts of parts, so that no task sees a whole language."""
    from pyspark.sql import Window as W

    order = [F.desc("score"), F.desc("a"), "phrase"]
    found = stored(found, "collocations")
    parts = max(1, -(-found.count() // RANKED))
    while True:
        place = F.row_number().over(W.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(parts))).orderBy(*order))
        found = found.withColumn("rank", place.cast("long")).filter(F.col("rank") <= most)
        if parts == 1:
            return found
        found, parts = found.drop("rank"), max(1, min(-(-parts * most // RANKED), parts // 2))


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best collocations of each language."""
    frequent, _ = frequent_phrases(table(spark, sf_dir, "documents"))
    return ranked(collocations(frequent)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
ws AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM ws, (SELECT unnest([1, 2, 3]) AS k))),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
cands AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND f >= 10),
cuts AS (SELECT c.lang, c.k, c.phrase, a, cut, x.f AS l, y.f AS r, CAST(1000000 * CAST(a AS HUGEINT) * a // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
 FROM (SELECT *, unnest(range(1, k)) AS cut FROM cands) c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:cut], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[cut + 1:], ' ')),
least AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS o FROM cuts) WHERE o = 1),
over AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM cands WHERE k = 3) GROUP BY ALL),
best AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM least LEFT JOIN over USING (lang, phrase) WHERE k = 3 OR longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM best JOIN totals USING (lang) WHERE rank <= 2000"""
