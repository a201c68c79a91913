import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import packing


def expand(runs):
    return [[n for n, t in contents for _ in range(t)] for count, contents in runs for _ in range(count)]


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 1024), st.integers(1, 40), max_size=60))
def test_plan_holds_every_piece_once(histogram):
    full = expand(packing.plan(histogram))
    assert all(sum(s) <= 1024 for s in full)
    got = {}
    for s in full:
        for n in s:
            got[n] = got.get(n, 0) + 1
    assert got == histogram


def test_plan_is_close_to_the_least():
    rng = np.random.default_rng(1)
    lengths, counts = np.unique(rng.integers(1, 1025, 20000), return_counts=True)
    histogram = dict(zip(lengths.tolist(), counts.tolist()))
    least = -(-sum(n * c for n, c in histogram.items()) // 1024)
    assert sum(c for c, _ in packing.plan(histogram)) <= 1.01 * least


def test_configurations_place_the_large_pieces():
    rng = np.random.default_rng(3)
    for lengths, bound in ((np.minimum(1024, rng.lognormal(6, 0.9, 200_000).astype(int) + 1), 1.005), (rng.integers(1, 1025, 200_000), 1.005)):
        histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
        made, rest = packing.configured(histogram, 1024, packing.GROUPS)
        large = sum(c for n, c in histogram.items() if 256 < n < 1024)
        placed = sum(count * sum(t for _, t in contents) for count, contents, _ in made)
        assert placed > 0.99 * large
        # All of these configurations are in the plan, as they are or with more pieces in what they left.
        held = sum(c * sum(t for n, t in contents if n > 256) for c, contents in packing.plan(histogram))
        assert held == large + histogram.get(1024, 0)
        assert sum(c for c, _ in packing.plan(histogram)) <= bound * sum(n * c for n, c in histogram.items()) / 1024 + 1


def test_ids_equal_the_public_tokenizer():
    import public_tokenizers as public
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    texts = ["<|endoftext|>", "a<|endoftext|>", "<|endoftext|> <|endoftext|>a  b", "", " a", "a  b", "it's we'll\tx\n\ny", "<|endoftext|> x", "é ü 　 中文 123 4.5!!", "a\nb c\nd", "x" * 3000, "a b \n c", "end ", "\n", "a\r\nb", "😀 😀", "a b c"]
    w = packing.words()
    for x in texts * 2:
        assert w.with_added(x) == np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes(), x


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab1 ,.'\n\t éS中-")), max_size=40))
def test_ids_of_any_text(x):
    w = packing.words()
    assert w.ids(x) == w.plain(x)


def test_pack(spark):
    rows = [(1, "a b c"), (2, None), (3, ""), (4, "word " * 3000), (5, "x y"), (5, "x y"), (None, "n"), (7, "z " * 200000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = packing.pack(df).toPandas()
    w = packing.words()
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert (s.offset == s.length.cumsum() - s.length).all() and s.length.sum() <= 1024
    four = got[got.doc_id == 4].sort_values("piece")
    ids = w.ids("word " * 3000) + (2).to_bytes(4, "little")
    assert b"".join(map(bytes, four.ids)) == ids and (four.length[1:] == 1024).all() and list(four.start) == list((four.length.cumsum() - four.length))
    assert len(got[got.doc_id == 5]) == 2 and got[got.doc_id == 3].length.tolist() == [1] and got.doc_id.isna().sum() == 1
    assert packing.pack(df.limit(0)).count() == 0


def test_query(spark, sf_dir):
    from quire.llm.packing import op4_best_fit_packing

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op4_best_fit_packing(spark, sf_dir).toPandas()
    w, total = packing.words(), 0
    for key, mine in got.groupby("doc_id"):
        ids = w.ids(texts[key]) + (2).to_bytes(4, "little")
        total += len(ids) // 4
        for r in mine.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)])
        assert mine.length.sum() == len(ids) // 4
    assert got.groupby("sequence_id").length.sum().max() <= 1024 and got.sequence_id.nunique() <= 1.03 * -(-total // 1024) + 1
    assert set(got.doc_id) == set(texts)


def test_added_tokens_have_the_ids_of_the_json_file(spark):
    import public_tokenizers as public
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n\ny  z ", "<|endoftext", "no token here"]
    got = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    want = {i: t.encode(x, add_special_tokens=False).ids + [packing.END_TOKEN] for i, x in enumerate(texts)}
    assert want[0] == [64, 220, 50256, 275, packing.END_TOKEN]
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in got} == want


def test_rare_words_are_not_encoded_one_by_one():
    import time

    w, rng = packing.words(), np.random.default_rng(4)
    rare = ["".join(map(chr, rng.integers(97, 123, 7))) for _ in range(60_000)]

    def seconds(job) -> float:
        start = time.process_time()
        job()
        return time.process_time() - start

    w.ids("a b")
    at_once = min(seconds(lambda: w.ids(" ".join(rare))) for _ in range(3))
    one_by_one = min(seconds(lambda: [w.plain(" " + x) for x in rare]) for _ in range(3))
    assert at_once < 0.75 * one_by_one
