import hashlib
import os
import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from quire.llm import substrings

SHAPE = "doc_id long, text string"


def brute(rows, k=13):
    """(id, n_words, n_removed, kept) of each row, by all windows of all rows; a null id is larger than any."""
    big = float("inf")
    split = [((big if i is None else i), (t or "").encode().split()) for i, t in rows]
    least = {}
    for i, w in split:
        for a in range(len(w) - k + 1):
            x = tuple(w[a : a + k])
            least[x] = min(i, least.get(x, big))
    out = []
    for (given, _), (i, w) in zip(rows, split):
        gone = {p for a in range(len(w) - k + 1) if least[tuple(w[a : a + k])] < i for p in range(a, a + k)}
        kept = [x for p, x in enumerate(w) if p not in gone]
        out.append((given, len(w), len(gone), b" ".join(kept).decode()))
    return out


def run(spark, rows, parts=3, **plan):
    df = spark.createDataFrame(rows, SHAPE).repartition(parts)
    got = substrings.without_repeats(df, **{"fewest": 4, **plan}).collect()
    for r in got:
        assert sum(s["last"] - s["first"] for s in r.spans) == r.n_removed
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=repr)


def passages(seed, docs=60, words=40, most=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)] + ["Ä", "ß", "中", "A", "a"]
    shared = [[rng.choice(vocabulary) for _ in range(rng.randint(10, 40))] for _ in range(5)]
    rows = []
    for i in range(docs):
        text = []
        while len(text) < rng.randint(1, most):
            text += rng.choice(shared)[rng.randint(0, 3) :] if rng.random() < 0.4 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 20))]
        rows.append((i, rng.choice([" ", "  ", "\n", "\t \r\n"]).join(text)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("plan", [{}, {"sample": 1, "hot_windows": 8}, {"sample": 1, "hot_windows": 8, "fewest": 1}])
def test_equals_brute_force(spark, plan):
    rows = passages(1)
    assert run(spark, rows, **plan) == sorted(brute(rows), key=repr)


def test_hot_minimisers_are_dealt_and_decided(spark):
    """One passage in every document, different neighbours: with the smallest buckets its windows meet again by window."""
    rng = random.Random(3)
    shared = " ".join(f"s{i}" for i in range(60))
    rows = [(i, " ".join([*(f"r{rng.randint(0, 10**6)}" for _ in range(20)), shared, *(f"q{rng.randint(0, 10**6)}" for _ in range(20))])) for i in range(200)]
    df = spark.createDataFrame(rows, SHAPE).repartition(8)
    _, _, hot, parts = substrings.shares(substrings.rows_of(df, "doc_id", "text"), sample=1, hot_windows=20, fewest=64)
    assert len(hot) >= 2 and parts.max() > 1
    assert run(spark, rows, parts=8, sample=1, hot_windows=20, fewest=64) == sorted(brute(rows), key=repr)


def test_repeated_words_and_copies(spark):
    rows = [(i, "same " * 40) for i in (5, 3, 9)] + [(3, "same " * 40), (4, "x y " * 30), (7, "y x " * 30), (8, "x y " * 30 + "z")]
    assert run(spark, rows) == sorted(brute(rows), key=repr)


def test_defined_cases(spark):
    long = " ".join(f"word{i % 977}" for i in range(5000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "few words"), (5, " ".join("abcdefghijklm")), (6, " ".join("abcdefghijklm")), (6, " ".join("abcdefghijklmn")), (None, " ".join("abcdefghijklm")), (None, long), (7, long), (7, long)]
    assert run(spark, rows) == sorted(brute(rows), key=repr)
    clash = spark.createDataFrame(rows, SHAPE).withColumn("doc", F.lit("x")).withColumn("digest", F.lit(1)).withColumn("n_words", F.lit(2)).withColumn("marks", F.lit(3))
    got = substrings.without_repeats(clash, fewest=2)
    assert got.columns == ["doc_id", "n_words", "n_removed", "spans", "kept"] and got.count() == len(rows)
    assert substrings.without_repeats(spark.createDataFrame([], SHAPE), fewest=2).count() == 0


def test_long_texts_in_pieces():
    """Pieces overlap by all but one word of a window, so every window is whole in one of them."""
    text = b"  ".join(b"w%d" % i for i in range(1000))
    for most in (1, 50, 777, len(text)):
        starts, words = [], text.split()
        for first, mine in substrings.pieces(text, most):
            assert mine == words[first : first + len(mine)]
            starts += range(first, first + max(0, len(mine) - 12))
        assert starts == list(range(988))


def test_pieces_in_a_task(spark, monkeypatch):
    text = " ".join(f"w{i * i % 5003}" for i in range(3000))
    assert sum(r.count.sum() for r in substrings.runs([1], [1], [text.encode()], 500)) == 3000 - 12 and len(list(substrings.runs([1], [1], [text.encode()], 500))) > 10
    rows = [(1, text), (2, text[200:9000])]
    assert run(spark, rows) == sorted(brute(rows), key=repr)


def test_different_windows_of_one_key_stay_apart(monkeypatch):
    monkeypatch.setattr(substrings, "_A", substrings.np.uint64(0))  # every key is equal
    w = substrings.Windows()
    for doc, text in ((1, b"a " * 12 + b"b"), (2, b"a " * 12 + b"c"), (3, b"a " * 12 + b"c"), (4, b"a " * 12 + b"b")):
        one = lambda x, t: substrings.np.array([x], t)
        w.add([one(doc, "i8"), one(0, "i8"), one(0, "i4"), one(1, "i4"), one(False, "?")], text.split(b" "))
    assert sorted(w.decided()[0].column("doc").to_pylist()) == [3, 4]


def test_query_equals_its_sql(spark, sf_dir):
    con = duckdb.connect()
    path = f"{sf_dir}/documents.parquet"
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    result = con.execute(substrings.ORACLE_SQL)
    names = [d[0] for d in result.description]
    got = [tuple(r[n] for n in names) for r in substrings.op11_substring_dedup(spark, sf_dir).collect()]
    assert sorted(got) == sorted(result.fetchall()) and sum(r[2] for r in got) > 0
    assert all(len(r[3]) == len(hashlib.sha256(b"").hexdigest()) for r in got)


def test_words_of_several_texts_get_the_same_numbers():
    """Words are numbered by Arrow, over all texts of a bucket; a window of one text meets its equal in another one."""
    assert [w[:-1] for w in substrings.word_array("ä bb  ä".replace("  ", " ").encode()).to_pylist()] == ["ä".encode(), b"bb", "ä".encode()]
    w, words = substrings.Windows(), [b"w%d" % i for i in range(substrings.WINDOW)]
    one = lambda x, t: substrings.np.array([x], t)
    for doc, ws in ((3, words), (1, words[::-1]), (2, words)):
        w.add_text([one(doc, "i8"), one(0, "i8"), one(5, "i4"), one(1, "i4"), one(True, "?")], b" ".join(ws))
    spans, left = w.decided()
    assert spans.to_pylist() == [{"doc": 3, "digest": 0, "first": 5, "last": 5 + substrings.WINDOW, "places": None, "window": None}]
    assert sorted((d, s) for d, _, _, s in left) == [(1, b" ".join(words[::-1])), (2, b" ".join(words))]


def test_many_texts_of_a_bucket_cost_what_one_does():
    """The dictionary is one for all texts and is not read again for each of them."""
    words = [b"w%d" % (i * 7919 % 60_000) for i in range(120_000)]
    one = lambda x, t: substrings.np.array([x], t)

    def decided(size):
        w, before = substrings.Windows(), time.process_time()
        for i in range(0, len(words), size):
            w.add_text([one(i, "i8"), one(0, "i8"), one(i, "i4"), one(size - substrings.WINDOW + 1, "i4"), one(False, "?")], b" ".join(words[i : i + size]))
        spans = w.decided()[0]
        return time.process_time() - before, spans.column("first").to_pylist()

    decided(len(words))
    whole, many = decided(len(words)), decided(60)
    assert whole[1] == [] and many[1] == list(range(60_000, 120_000, 60))
    assert many[0] < 5 * whole[0] + 1


def test_arrow_has_one_dictionary_for_all_texts():
    numbered = substrings.pa.chunked_array([substrings.word_array(t) for t in (b"a b", b"c a", b"", b"d")]).dictionary_encode()
    assert len({c.dictionary.buffers()[2].address for c in numbered.chunks}) == 1
    assert all(c.dictionary.to_pylist() == [b"a ", b"b ", b"c ", b" ", b"d "] for c in numbered.chunks)
