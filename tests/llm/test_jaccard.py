import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(docs):
    """docs (doc_id, text) -> (doc_id, n, component_id), in order."""
    sets = [grams(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(docs):
        if k is not None:
            least[root(i)] = min(least.get(root(i), k), k)
    return [(k, len(sets[i]), least.get(root(i), k)) for i, (k, _) in enumerate(docs)]


def fixture(seed, n=250):
    rng = np.random.default_rng(seed)
    passage = [f"p{i}" for i in range(30)]
    docs = []
    for i in range(n):
        kind = rng.random()
        if docs and kind < 0.6:
            words = (docs[int(rng.integers(len(docs)))][1] or "").split()
            for _ in range(int(rng.integers(0, 4))):
                if words:
                    words[int(rng.integers(len(words)))] = f"e{rng.integers(9999)}"
            if rng.random() < 0.3:
                words = words[int(rng.integers(0, 5)) :]
        else:
            words = [f"w{x}" for x in rng.integers(0, 3000, int(rng.integers(0, 120)))]
            if kind < 0.8:
                words = words[:20] + passage + words[20:]
        text = " ".join(words)
        docs.append((int(rng.permutation(1000)[0]) * 1000 + i, text.upper() if rng.random() < 0.1 else text))
    return docs


def run(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    return sorted((tuple(r)[:3] for r in jaccard.similar(df).collect()), key=str)


@pytest.mark.parametrize("seed", [0, 1])
def test_against_brute_force(spark, seed):
    docs = fixture(seed)
    assert run(spark, docs) == sorted(brute(docs), key=str)


def test_frequent_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FREQUENT", 3)
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    docs = fixture(7, 150)
    assert run(spark, docs) == sorted(brute(docs), key=str)


def test_chain_and_threshold(spark):
    base = [f"w{i}" for i in range(104)]  # 100 n-grams
    docs = [(i, " ".join(base[: 104 - 4 * i])) for i in range(12)]  # each is near the next, the ends are not
    docs += [(50, " ".join(f"v{i}" for i in range(104))), (51, " ".join(f"v{i}" for i in range(84))), (52, " ".join(f"u{i}" for i in range(104))), (53, " ".join(f"u{i}" for i in range(83)))]
    got = {k: c for k, _, c in run(spark, docs)}
    assert [got[i] for i in range(12)] == [0] * 12 and got[51] == 50 and got[53] == 53


def test_edge_cases(spark):
    docs = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  b"), (6, "a b c"), (4, "a b"), (None, "a b"), (None, "lonely text that is here now"), (9, "x " * 200000), (8, "x x x x x x"), (10, "é É ü ß a b"), (11, "é É ü ß A B")]
    assert run(spark, docs) == sorted(brute(docs), key=str)
    assert run(spark, []) == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in jaccard.op8_ngram_jaccard(spark, sf).collect()), key=str)
    assert got == sorted(brute(docs), key=str)


def test_one_of_each_keeps_columns(spark):
    docs = [(i, t, "k", i) for i, t in enumerate(["a b c d e f", "A b c d e f", "x y", "x y", "", None])] + [(0, "a b c d e f", "k", 0), (5, None, "k", 5)]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_ string, component long")
    got = jaccard.one_of_each(df)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == [0, 2, 4, 5, 5]


def test_which_of_equal_rows_stays_is_defined(spark):
    text = "one two three four five six seven"
    rows = [(1, text, s, [s]) for s in ("b", "a", "c", None)] + [(2, None, "x", ["y"]), (2, None, "x", ["y"])]
    for seed in (1, 2, 3):
        df = spark.createDataFrame(rows, "doc_id long, text string, source string, tags array<string>").repartition(seed).orderBy(F.rand(seed))
        got = sorted(((r.doc_id, r.source) for r in jaccard.one_of_each(df).collect()), key=str)
        assert got == [(1, None), (2, "x"), (2, "x")]
