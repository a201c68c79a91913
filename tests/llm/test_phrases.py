import os
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from quire.llm import phrases

SHAPE = "doc_id long, lang string, text string"


def brute(rows, support=10, most=2000, cover=50):
    """(lang, rank, phrase, a, l, r, n, score) by counting every phrase."""
    f, n = Counter(), Counter()
    for _, lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lower):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    out = {}
    for (lang, p), a in f.items():
        if len(p) < 2 or a < support:
            continue
        if len(p) == 2 and any(len(q) == 3 and m == lang and b >= support and 100 * b >= cover * a and p in (q[:2], q[1:]) for (m, q), b in f.items()):
            continue
        score, _, left, right = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return [(lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:most], 1)]


def run(spark, rows, parts=3, most=2000, **plan):
    df = spark.createDataFrame(rows, SHAPE).repartition(parts)
    frequent, passes = phrases.frequent_phrases(df, **plan)
    columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r[c] for c in columns) for r in phrases.ranked(phrases.collocations(frequent), most).collect()), passes


def texts(seed, docs=120, vocabulary=12):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["The", "Ärger", "中文", "x y", "İ"]
    stock = [" ".join(rng.choice(words) for _ in range(3)) for _ in range(4)]
    out = []
    for i in range(docs):
        parts = [rng.choice(stock) if rng.random() < 0.4 else rng.choice(words) for _ in range(rng.randint(0, 40))]
        out.append((i, rng.choice(["en", "de", None, "und"]), "".join(p + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n"]) for p in parts)))
    return out


@pytest.mark.parametrize("plan", [{}, {"sample": 1, "sample_support": 1}, {"sample": 40, "sample_support": 6}, {"sample": 100_000}])
def test_equals_brute_force_whatever_the_sample(spark, plan):
    rows = texts(1)
    got, passes = run(spark, rows, **plan)
    assert got == sorted(brute(rows)) and len(got) > 30
    # A sample of everything leaves no failure; one of nearly nothing needs passes for pairs and triples.
    assert passes == 1 if plan.get("sample") == 1 else passes <= 4
    assert passes == 3 or plan.get("sample") != 100_000


def test_small_bitmaps_only_count_more(spark, monkeypatch):
    monkeypatch.setattr(phrases, "FILTER_BITS", phrases.SEGMENT)
    rows = texts(2, 60, 400) + [(i, "en", " ".join(f"v{j * j % 30011}" for j in range(60_000))) for i in (900, 901)]  # three bits full of four
    assert run(spark, rows, sample=2, sample_support=1)[0] == sorted(brute(rows))


def test_ranks_in_parts(spark, monkeypatch):
    rows = texts(3)
    want = sorted(brute(rows, most=20))
    monkeypatch.setattr(phrases, "RANKED", 30)
    assert run(spark, rows, most=20)[0] == want


@pytest.mark.parametrize("most", [1, 7, 50])
def test_long_texts_are_cut_between_words(most):
    class All(phrases.Members):
        def __call__(self, keys, first=None):
            return phrases.np.full(len(keys), first is None)

    def found(members, most):
        counter, out = phrases.Counter("en"), Counter()
        counter.add([b"a b c d. e f g h " * 40, b"x", b""], most)
        for length, keys, f, names in counter.results(members, 0):
            out.update(dict(zip(((length, k) for k in (keys.tolist() if names is None else names.to_pylist())), f.tolist())))
        return +out

    for members in (None, All([])):
        assert found(members, most) == found(members, 10**6)
    assert found(All([]), most)[3, b"g h a"] == 39 and (3, b"c d e") not in found(All([]), most)


def test_scores_are_exact(spark):
    big = 10**12 + 7
    rows = [(big, big, big), (big, big + 1, big), (big - 1, big + 12345, big + 678), (10, 10, 10), (3 * 10**9, 3 * 10**9, 4 * 10**9)]
    got = spark.createDataFrame(rows, "a long, l long, r long").select(phrases.score(F.col("a"), F.col("l"), F.col("r"))).collect()
    assert [r[0] for r in got] == [10**6 * a * a // (x * y) for a, x, y in rows]


def test_defined_cases(spark):
    rows = [(1, None, None), (1, "en", ""), (None, "en", " .,; \n"), (2, None, "a b " * 20), (2, None, "a b " * 20), (3, "und", "a b"), (4, "", "c d. " * 12)]
    assert run(spark, rows)[0] == sorted(brute(rows))
    clash = spark.createDataFrame(rows, SHAPE).withColumn("length", F.lit("x")).withColumn("phrase", F.lit(1)).withColumn("f", F.lit(2)).withColumn("deal", F.lit(3))
    assert phrases.ranked(phrases.collocations(phrases.frequent_phrases(clash)[0])).count() == len(brute(rows))
    assert run(spark, [(1, "en", "x")] * 0 or [(1, "en", None)])[0] == []
    assert phrases.ranked(phrases.collocations(phrases.frequent_phrases(spark.createDataFrame([], SHAPE))[0])).count() == 0


def test_query_equals_its_sql(spark, sf_dir):
    con = duckdb.connect()
    path = f"{sf_dir}/documents.parquet"
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    result = con.execute(phrases.ORACLE_SQL)
    names = [d[0] for d in result.description]
    got = [tuple(r[n] for n in names) for r in phrases.op13_phrase_mining(spark, sf_dir).collect()]
    assert sorted(got) == sorted(result.fetchall()) and len(got) > 100
