import itertools
import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quire.llm import language


def all_cuts(word, known, p, unknown):
    """Sum over every segmentation, by enumeration."""
    total = 0.0
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        parts, start = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                parts.append(word[start:i])
                start = i
        parts.append(word[start:])
        q = 1.0
        for x in parts:
            q *= p[known[x]] if x in known else p[unknown] if len(x) == 1 else 0.0
        total += q
    return total


def piece_names(pc):
    back = {}
    names = {0: ""}
    for key, to in sorted(zip(pc.keys.tolist(), pc.to.tolist()), key=lambda x: x[1]):
        back[to] = (key >> 21, chr(key & 0x1FFFFF))
    for node, piece in enumerate(pc.piece_at.tolist()):
        if piece >= 0:
            text, at = "", node
            while at:
                at, c = back[at]
                text = c + text
            names[piece] = text
    return {t: i for i, t in names.items() if t}


def test_forward_sums_all_segmentations():
    pc = language.pieces()
    known = piece_names(pc)
    rng = np.random.default_rng(0)
    p = rng.random((2, pc.n))
    p /= p.sum(axis=1, keepdims=True)
    words = ["the", "a", "streets", "ÿ中x", "überall", "zqj"]
    got = pc.log_words(words, p)
    for i, w in enumerate(words):
        for k in range(2):
            assert np.isclose(got[i, k], np.log(all_cuts("▁" + w, known, p[k], pc.n - 1)))
    # Expected counts: each segmentation's pieces, weighed by its share, cover every character once.
    counts = pc.expected(words, np.array([1.0, 2, 3, 1, 1, 5]), p[0])
    sizes = np.ones(pc.n)
    for t, i in known.items():
        sizes[i] = len(t)
    assert np.isclose((counts * sizes).sum(), sum(c * (len(w) + 1) for w, c in zip(words, [1, 2, 3, 1, 1, 5])))


def test_long_words_of_rare_pieces_keep_their_probability():
    """Sums of 41 factors down to the least probability, against sums of logarithms."""
    pc = language.pieces()
    rng = np.random.default_rng(1)
    words = ["漢" * 40, "ω" * 40, "straße" * 6 + "xyzq", "а" * 39, "漢字" * 20]
    for p in (np.full((2, pc.n), language.LEAST), np.exp(-27 * rng.random((2, pc.n)))):
        lengths, _, edges = pc.lattice(words)
        got = pc.log_words(words, p)
        for k in range(2):
            logs = np.full((len(words), len(edges)), -np.inf)
            logs[:, 0] = 0
            for end in range(1, len(edges)):
                for w, start, piece in edges[end].T:
                    logs[w, end] = np.logaddexp(logs[w, end], logs[w, start] + np.log(p[k, piece]))
            assert np.allclose(got[:, k], logs[np.arange(len(words)), lengths], rtol=1e-12)
        counts = pc.expected(words, np.ones(len(words)), p[0])
        assert np.isfinite(counts).all() and counts.sum() >= len(words)
    assert len(set(got[:, 0].tolist())) == len(words)
    shares, _ = language.Model(["a", "b"], p, None).scores(["漢" * 4000])
    assert np.isfinite(shares).all()


def test_words_beyond_the_memory_do_not_change_scores(monkeypatch):
    pc = language.pieces()
    rng = np.random.default_rng(0)
    p = rng.random((2, pc.n))
    texts = ["one two three", "four " * 50 + "x" * 100, None, "12 34"]
    a, n = language.Model(["a", "b"], p, None).scores(texts)
    monkeypatch.setattr(language, "MEMORY", 1)
    m = language.Model(["a", "b"], p, None)
    b = np.concatenate([m.scores([t])[0] for t in texts])
    assert np.allclose(a, b) and n.tolist() == [3, 53, 0, 0]


def test_edge_cases(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the house is here and there", "en"), ("das haus ist hier und da", "de")] * 20)]
    rows += [(100, None, "en"), (101, "", None), (102, "123 !!", "de"), (103, "the house", None), (None, "das haus", None), (0, "the house", None), (105, "das haus und da " * 50000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = language.train(df)
    got = {}
    for r in language.predict(df.withColumnRenamed("lang", "score"), model).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    for key, name in ((100, "und"), (101, "und"), (102, "und"), (103, "en"), (None, "de"), (105, "de")):
        assert got[key][0].lang_pred == name
        assert 0 <= got[key][0].score <= 1 and (name != "und" or got[key][0].score == 0)
    empty = language.train(df.limit(0))
    assert {r.lang_pred for r in language.predict(df, empty).collect()} == {"und"}
    assert language.predict(df.limit(0), model).count() == 0


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    got = language.op6_language_id(spark, sf_dir).join(docs, "doc_id").filter("held_out").toPandas()
    assert len(got) > 20 and (got.lang == got.lang_pred).mean() > 0.95


def plain_model(rows, rounds):
    """Piece probabilities by language: expected counts over all segmentations, word by word, in logarithms."""
    import public_tokenizers as public
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    names = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    known = {p for p in names if p.removeprefix("▁").isalpha() and p == p.lower() or p == "▁"}
    longest, other = max(map(len, known)), None
    words = {}
    for lang, text in rows:
        words.setdefault(lang, Counter()).update(language.words_of(text))

    def edges(s):
        for a in range(len(s)):
            found = [s[a:b] for b in range(a + 1, min(len(s), a + longest) + 1) if s[a:b] in known]
            yield from ((a, a + len(p), p) for p in found)
            if s[a] not in known:
                yield a, a + 1, other

    cuts = {w: sorted(edges("▁" + w), key=lambda e: e[1]) for found in words.values() for w in found}

    def add(a, b):
        return max(a, b) + math.log1p(math.exp(-abs(a - b))) if a > -math.inf and b > -math.inf else max(a, b)

    def forward(w, p):
        alpha = [0.0] + [-math.inf] * (len(w) + 1)
        for a, b, piece in cuts[w]:
            alpha[b] = add(alpha[b], alpha[a] + p(piece))
        return alpha

    models = {}
    for lang, counts in words.items():
        logs, least = {}, -math.log(len(known) + 1)
        p = lambda piece: logs.get(piece, least)  # noqa: B023, E731
        for _ in range(rounds):
            total = Counter()
            for w, n in counts.items():
                alpha = forward(w, p)
                beta = [-math.inf] * (len(w) + 1) + [0.0]
                for a, b, piece in sorted(cuts[w], key=lambda e: -e[0]):
                    beta[a] = add(beta[a], beta[b] + p(piece))
                for a, b, piece in cuts[w]:
                    total[piece] += n * math.exp(alpha[a] + p(piece) + beta[b] - alpha[-1])
            mass = sum(total.values()) + language.PSEUDO * (len(known) + 1)
            new = {k: max((v + language.PSEUDO) / mass, language.LEAST) for k, v in total.items()}
            new[other] = max(new.get(other, language.PSEUDO / mass), language.UNKNOWN)
            logs, least = {k: math.log(v) for k, v in new.items()}, math.log(max(language.PSEUDO / mass, language.LEAST))
        models[lang] = (logs, least)

    def score(text):
        out = {}
        for lang, (logs, least) in models.items():
            out[lang] = 0.0
            for w, n in Counter(language.words_of(text)).items():
                cuts.setdefault(w, sorted(edges("▁" + w), key=lambda e: e[1]))
                out[lang] += n * forward(w, lambda piece: logs.get(piece, least))[-1]
        return out

    return score


def test_training_and_prediction_equal_plain_python(spark, sf_dir):
    """The query on whole documents against a model without tries, scaling or Spark; the documents are few enough for plain Python."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("length(text) < 1500 AND doc_id % 3 = 0").select("doc_id", "text", "lang")
    given = docs.collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in given}
    score = plain_model([(r.lang, r.text) for r in given if not held[r.doc_id] and r.lang and r.text], language.ROUNDS)
    model = language.train(docs.filter(language.crc_mod(F.col("doc_id"), 4) != 2))
    got = {r.doc_id: r for r in language.predict(docs, model).collect()}
    assert len(got) == len(given) > 20 and any(held.values())
    for r in given:
        logs = score(r.text)
        best = max(logs, key=logs.get)
        assert got[r.doc_id].lang_pred == best
        assert abs(got[r.doc_id].score - 1 / sum(math.exp(v - logs[best]) for v in logs.values())) < 1e-6
