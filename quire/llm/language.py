"""Language identification by unigram pieces, summed over all segmentations.

The pieces are those of a fixed public vocabulary (lower-case letter strings; a mark in front means the start of a word).
Each language has a probability for each piece. A word's probability is the sum over all ways to cut it into pieces, by
the forward algorithm; a text's is the product over its words. A fixed factor for each character, which all ways to cut a
word share, keeps the sums of the longest words within doubles; it leaves as a logarithm. Piece probabilities come from expected counts over the
segmentations of labelled words (expectation maximisation), computed by Spark tasks; only counts per piece and language
reach the driver, which the vocabulary bounds.

A word is a run of letters, lower-cased; runs over LONGEST letters are cut. Defined cases: null text, or text without a
letter, is `und` with score 0, as is every text if no language was learned; equal scores go to the first language by
name; rows that repeat an id are predicted each; an empty table stays empty; null lang is not learned from; a very long
text is scored whole, by its distinct words; other columns stay, but those named like the three new ones are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import bounded_sample, crc_mod, released, schema_of, stored, table, text_parts

LONGEST = 40
#: Texts of each language that are learned from, at most (about; chosen by hash).
TRAINING_TEXTS = 1000
ROUNDS = 4
#: What each piece counts before any text is seen, and the least probability of a character outside the vocabulary.
PSEUDO, UNKNOWN = 0.01, 1e-6
#: The least probability of any piece, and the logarithm of the factor for each character: a word of LONGEST letters and
#: its mark stays between exp(-41 * (27.7 - 13)) and exp(41 * 13), which doubles hold with full precision.
LEAST, PER_CHARACTER = 1e-12, 13.0
#: Words whose probabilities a worker remembers, and characters worked on at once.
MEMORY, AT_ONCE = 100_000, 1 << 20
#: Words whose segmentations are held at once.
PART = 5_000
START = "▁"

LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    found = LETTERS.findall(text.lower())
    if any(len(w) > LONGEST for w in found):
        found = [w[i : i + LONGEST] for w in found for i in range(0, len(w), LONGEST)]
    return found


class Pieces:
    """The vocabulary as a trie in arrays: (node, character) -> node, node -> piece."""

    def __init__(self, vocabulary: str | None = None):
        import public_tokenizers as public
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=vocabulary or public.path("piece_bpe_32k.model"))
        names = (model.id_to_piece(i) for i in range(model.get_piece_size()))
        pieces = sorted({p for p in names if p.removeprefix(START).isalpha() and p == p.lower() or p == START})
        nodes: dict[tuple[int, int], int] = {}
        self.n = len(pieces) + 1  # the last is any character outside the vocabulary
        piece_at = [-1]
        for i, p in enumerate(pieces):
            node = 0
            for c in p:
                node = nodes.setdefault((node, ord(c)), len(nodes) + 1)
                if node == len(piece_at):
                    piece_at.append(-1)
            piece_at[node] = i
        self.piece_at = np.array(piece_at)
        keys = np.array([n << 21 | c for n, c in nodes], np.int64)
        sort = np.argsort(keys)
        self.keys, self.to = keys[sort], np.fromiter(nodes.values(), np.int64, len(nodes))[sort]
        self.longest = max(map(len, pieces), default=1)
        self.factor = np.exp(PER_CHARACTER * np.array([*map(len, pieces), 1]))

    def lattice(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Words (with the start mark) -> lengths, and for each end place the edges (word, start place, piece)."""
        lengths = np.array([len(w) + 1 for w in words])
        width = int(lengths.max())
        chars = np.zeros((len(words), width + self.longest), np.int64)
        flat = np.frombuffer((START + START.join(words)).encode("utf-32-le"), np.uint32).astype(np.int64)
        row = np.repeat(np.arange(len(words)), lengths)
        chars[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
        edges: list[list[np.ndarray]] = [[] for _ in range(width + 1)]
        for start in range(width):
            word = np.flatnonzero(lengths > start)
            node = np.zeros(len(word), np.int64)
            single = np.ones(len(word), bool)
            first = word
            for k in range(1, self.longest + 1):
                key = node << 21 | chars[word, start + k - 1]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                ok = self.keys[at] == key
                word, node = word[ok], self.to[at[ok]]
                if not len(word):
                    break
                piece = self.piece_at[node]
                hit = piece >= 0
                if k == 1:
                    single[np.searchsorted(first, word[hit])] = False
                if hit.any():
                    edges[start + k].append(np.stack([word[hit], np.full(hit.sum(), start), piece[hit]]))
            if single.any():
                w = first[single]
                edges[start + 1].append(np.stack([w, np.full(len(w), start), np.full(len(w), self.n - 1)]))
        return lengths, chars, [np.concatenate(e, axis=1) if e else np.zeros((3, 0), np.int64) for e in edges]

    def forward(self, lengths: np.ndarray, edges: list[np.ndarray], p: np.ndarray) -> np.ndarray:
        """alpha[word, place] for one language's probabilities: the sum over all segmentations up to each place,
        times exp(PER_CHARACTER * place)."""
        scaled = p * self.factor
        alpha = np.zeros((len(lengths), len(edges)))
        alpha[:, 0] = 1
        for end in range(1, len(edges)):
            w, start, piece = edges[end]
            alpha[:, end] = np.bincount(w, alpha[w, start] * scaled[piece], minlength=len(lengths))
        return alpha

    def log_words(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """log probability of each word in each language; p[language, piece]."""
        out = np.zeros((len(words), len(p)))
        order = np.argsort([len(w) for w in words], kind="stable")
        for part in np.array_split(order, -(-len(words) // PART)):  # words of like lengths together
            mine = [words[i] for i in part]
            lengths, _, edges = self.lattice(mine)
            for k in range(len(p)):
                out[part, k] = np.log(self.forward(lengths, edges, p[k])[np.arange(len(mine)), lengths]) - PER_CHARACTER * lengths
        return out

    def expected(self, words: list[str], counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected count of each piece over the segmentations of the words; the factors of forward cancel out."""
        total, scaled = np.zeros(self.n), p * self.factor
        order = np.argsort([len(w) for w in words], kind="stable")
        for part in np.array_split(order, -(-len(words) // PART)):
            mine = [words[i] for i in part]
            lengths, _, edges = self.lattice(mine)
            alpha = self.forward(lengths, edges, p)
            at = np.arange(len(mine))
            beta = np.zeros_like(alpha)
            beta[at, lengths] = counts[part] / alpha[at, lengths]
            for end in range(len(edges) - 1, 0, -1):
                w, start, piece = edges[end]
                flow = scaled[piece] * beta[w, end]
                total += np.bincount(piece, alpha[w, start] * flow, minlength=self.n)
                np.add.at(beta, (w, start), flow)
        return total


_PIECES: dict[str | None, Pieces] = {}


def pieces(vocabulary: str | None = None) -> Pieces:
    if vocabulary not in _PIECES:
        _PIECES[vocabulary] = Pieces(vocabulary)
    return _PIECES[vocabulary]


class Model:
    """Languages and their piece probabilities; small enough to go with the task."""

    def __init__(self, languages: list[str], p: np.ndarray, vocabulary: str | None):
        self.languages, self.p, self.vocabulary = languages, p, vocabulary
        self.known: dict[str, int] = {}
        self.logs = np.zeros((0, len(languages)))

    def __getstate__(self):
        return {"languages": self.languages, "p": self.p, "vocabulary": self.vocabulary}

    def __setstate__(self, state):
        self.__init__(**state)

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each text in each language, and its number of words."""
        each = [words_of(t) if t else [] for t in texts]
        mine = {w for ws in each for w in ws}
        new = list(mine - self.known.keys())
        if len(self.known) + len(new) > len(self.logs):  # forget, and make room for what these texts need at least
            self.known, new = {}, list(mine)
            self.logs = np.zeros((max(MEMORY, len(new)), len(self.languages)))
        if new:
            here = range(len(self.known), len(self.known) + len(new))
            self.logs[here.start : here.stop] = pieces(self.vocabulary).log_words(new, self.p)
            self.known.update(zip(new, here))
        find = self.known.__getitem__
        out = np.zeros((len(texts), len(self.languages)))
        for i, ws in enumerate(each):
            if ws:
                out[i] = self.logs[list(map(find, ws))].sum(axis=0)
        return out, np.array([len(ws) for ws in each])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def flush():
        keys = list(held)
        out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([held[k] for k in keys], pa.int64())], ["lang", "word", "n"])
        held.clear()
        return out

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held.update((lang, w) for w in words_of(text or ""))
            if len(held) > MEMORY:
                yield flush()
    yield flush()


def train(docs: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", most: int = TRAINING_TEXTS, rounds: int = ROUNDS, vocabulary: str | None = None) -> Model:
    """Learns piece probabilities from the rows with a language (`most` of each at most)."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).filter("lang is not null and text is not null")
    sample = bounded_sample(rows, "doc_id", "lang", most, 6)
    counts = stored(sample.select("lang", "text").mapInArrow(released(_count_words), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "lang-words")
    languages = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    n = pieces(vocabulary).n
    p = np.full((len(languages), n), 1.0 / n)
    for _ in range(rounds if languages else 0):
        model = Model(languages, p, vocabulary)

        def step(batches, model=model):
            total = np.zeros_like(model.p)
            for batch in batches:
                lang, word, n = (np.array(batch.column(i).to_pylist(), object) for i in range(3))
                for k, name in enumerate(model.languages):
                    m = lang == name
                    if m.any():
                        total[k] += pieces(model.vocabulary).expected(word[m].tolist(), n[m].astype(float), model.p[k])
            k, piece = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(piece, pa.int32()), pa.array(total[k, piece], pa.float64())], ["k", "piece", "n"])

        sums = counts.mapInArrow(released(step), "k int, piece int, n double").groupBy("k", "piece").agg(F.sum("n").alias("n")).toPandas()
        total = np.full_like(p, PSEUDO)
        total[sums.k, sums.piece] += sums.n
        p = np.maximum(total / total.sum(axis=1, keepdims=True), LEAST)
        p[:, -1] = np.maximum(p[:, -1], UNKNOWN)
    return Model(languages, p, vocabulary)


def predict(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds lang_pred, score (the language's share of the probability) and n_letter_words to the kept columns (all by default)."""
    keep = keep if keep is not None else [c for c in docs.columns if c not in ("lang_pred", "score", "n_letter_words")]
    rows = docs.select(*keep) if text in keep else docs.select(*keep, F.col(text).alias("text_"))
    at = keep.index(text) if text in keep else len(keep)

    def run(batches):
        for batch in batches:
            for part, texts in text_parts(batch.column(at), AT_ONCE, as_bytes=False):
                logs, n = model.scores(texts)
                names, shares = ["und"] * len(n), np.zeros(len(n))
                if model.languages:
                    best = logs.argmax(axis=1)
                    shares = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
                    names = [model.languages[b] if m else "und" for b, m in zip(best.tolist(), n.tolist())]
                    shares[n == 0] = 0
                old = [batch.column(i).slice(part.start, len(n)) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*old, pa.array(names), pa.array(shares, pa.float64()), pa.array(n, pa.int64())], [*keep, "lang_pred", "score", "n_letter_words"])

    return rows.mapInArrow(released(run), schema_of(docs.select(*keep), "lang_pred string, score double, n_letter_words long"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"))
    model = train(docs.filter("not held_out"))
    return predict(docs, model, keep=["doc_id", "held_out"])
