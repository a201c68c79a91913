import math
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from quire.llm import bytewords, lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def tree_by_recursion(train, texts, depth=2):
    """Context-tree weighting straight from its definition: counts per (context, decisions so far)."""
    counts = defaultdict(lambda: [0, 0])

    def steps(t):
        data = [lm.START] * depth + list(t.encode()) + [lm.END]
        for i in range(depth, len(data)):
            past = tuple(reversed(data[i - depth : i]))  # nearest byte first
            prefix = 1
            for b in reversed(range(8)):
                bit = data[i] >> b & 1
                yield past, prefix, bit
                prefix = prefix * 2 + bit

    for t in train:
        for past, prefix, bit in steps(t):
            for d in range(depth + 1):
                counts[past[:d], prefix][bit] += 1
    children = defaultdict(set)
    for context, prefix in list(counts):
        if context:
            children[context[:-1], prefix].add(context)
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(context, prefix):
        own = kt(*counts[context, prefix])
        if len(context) == depth:
            return own
        return np.logaddexp(own, sum(weighted(c, prefix) for c in children[context, prefix])) - math.log(2)

    def p_one(past, prefix, d):
        a, b = counts.get((past[:d], prefix), (0, 0))
        own = (b + 0.5) / (a + b + 1)
        if d == depth:
            return own
        w = math.exp(kt(a, b) - math.log(2) - weighted(past[:d], prefix)) if (past[:d], prefix) in counts else 0.5
        return w * own + (1 - w) * p_one(past, prefix, d + 1)

    out = []
    for t in texts:
        total = 0.0
        for past, prefix, bit in steps(t):
            p = p_one(past, prefix, 0)
            total -= math.log2(p if bit else 1 - p)
        out.append(total)
    return out


def rows_of(spark, train, probe):
    rows = [(i, False, t) for i, t in enumerate(train)] + [(1000 + i, True, t) for i, t in enumerate(probe)]
    return spark.createDataFrame(rows, "doc_id long, held_out boolean, text string").repartition(3)


def test_tree_against_the_definition(spark):
    train = ["abracadabra", "abba", "", "the cat é", "abracadabra abracadabra", "x" * 70]
    probe = ["abra", "", "zé cat", "qq", "abracadabra!", "xxxxxxxy"]
    df = rows_of(spark, train, probe)
    for depth, size in ((5, 1), (5, lm.CHUNK), (7, 30)):
        want = tree_by_recursion(train, train + probe, depth)
        got = {r.doc_id: r for r in lm.scores(df, size, depth).collect()}
        for i, (t, bits) in enumerate(zip(train + probe, want)):
            r = got[i if i < len(train) else 1000 + i - len(train)]
            assert abs(r.bits_per_byte * (len(t.encode()) + 1) - bits) < 1e-4 * bits + 1e-5, (depth, t)
            assert abs(r.score + bits * math.log10(2)) < 1e-4 * bits + 1e-5


def test_kt_of_large_counts():
    zeros, ones = np.array([0, 1, 5, 4094, 4095, 10**6, 0]), np.array([0, 0, 7, 3, 5000, 10**7, 10**9])
    want = [math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi) for a, b in zip(zeros.tolist(), ones.tolist())]
    got = lm.log_kt(zeros, ones)
    assert np.allclose(got[:5], want[:5], rtol=1e-12, atol=1e-9)
    assert np.allclose(got[5:], want[5:], rtol=0, atol=1e-4)  # doubles near 2e10, of which differences are taken, are 4e-6 apart


def test_squeezed_numbers_come_back():
    rng = np.random.default_rng(4)
    for n in (0, 1, 1000):
        sorted_ = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        assert (lm.unsqueeze_sorted(lm.squeeze_sorted(sorted_)) == sorted_).all()
        for kind in ("<u4", "<i8", "<f4"):
            x = rng.integers(0, 1 << 31, n).astype(kind)
            assert (lm.unsqueeze(lm.squeeze(x), kind) == x).all()


def test_more_text_and_more_depth_shorten_the_code_of_held_out_texts(spark):
    """What is learned keeps growing with the input and with the depth."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", (lm.crc_mod(F.col("doc_id"), 10) == 0).alias("held_out"))
    held = lambda df: df.filter("held_out").agg(F.avg("bits_per_byte")).first()[0]
    less = docs.filter("held_out or doc_id % 8 = 1")
    few, all_, shallow = held(lm.scores(less)), held(lm.scores(docs)), held(lm.scores(docs, depth=4))
    assert all_ < 0.97 * few and all_ < 0.98 * shallow


def test_hashes_tell_words_apart():
    texts = ["a b  c\tA", "", " x ", "ab a b", "é É", "w" * 5000]
    h, n = bytewords.hash_words([t.encode() for t in texts])
    words = [lower(w) for t in texts for w in WORD.findall(t)]
    assert n.tolist() == [len(WORD.findall(t)) for t in texts] and len(h) == len(words)
    assert len(set(h.tolist())) == len(set(words)) == len(set(zip(h.tolist(), words)))


def brute(docs):
    toks = [(k, held, [*WORD.findall(lower(t)), None]) for k, held, t in docs]
    c = Counter(x for _, held, ts in toks if not held for x in ts)
    n, v = sum(c.values()), len(c)
    return [(k, held, len(ts), sum(c[x] > 0 for x in ts), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in ts)) for k, held, ts in toks]


def test_word_scores(spark):
    docs = [(1, False, "the cat The dog"), (2, True, "the cow"), (3, False, None), (3, False, None), (None, False, "x " * 3000), (4, True, ""), (5, False, "éa\n b\tthe"), (6, True, "new " * 10)]
    df = spark.createDataFrame(docs, "doc_id long, held_out boolean, text string").repartition(3)
    for size in (1, 12 << 20):
        got = [tuple(r) for r in lm.scores(df, size).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score").collect()]
        key = lambda r: (str(r[0]), *map(str, r[1:5]), round(r[5], 6))
        assert sorted(map(key, got)) == sorted(map(key, brute(docs)))
    assert lm.scores(df.limit(0)).count() == 0
    none = lm.scores(df.withColumn("held_out", F.lit(True))).collect()
    assert {(r.n_known, r.train_tokens, r.base_score) for r in none} == {(0, 0, 0.0)}


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.h, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", (lm.crc_mod(F.col("doc_id"), 10) == 0).alias("h"), "text").collect()]
    want = {r[0]: r for r in brute(docs)}
    got = lm.op10_lm_score(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[1:5] and abs(r.base_score - w[5]) < 1e-6 * abs(w[5]) + 1e-9
        assert r.score < 0 and 0 < r.bits_per_byte < 8
