"""Language identification by a linear-chain conditional random field.

Words (a letter and the letters and combining marks behind it, lower-cased) are the chain's
positions and languages its labels.  A word's features are the character n-grams of its text
between end marks, so that those with a mark are its affixes, and its own identity, the lexicon
feature.  Feature weights and the transitions between labels are learned together; training chains
join pieces of documents of different languages, so switching is learned as well.
Forward-backward gives each word the probability of each language; a document's
language has the highest mean probability over its words.

Fitting uses a bounded sample of labelled rows: ``DOCS`` documents of each language, read whole
as chains of ``PIECE`` words.  Every language is learned; with more than ``WEIGHTS`` / ``BUCKETS`` of them
features share buckets.  Prediction reads every text whole.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is
everything if nothing was labelled.  Ties go to the first language in order of name.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCS, PIECE = 250, 64
#: Buckets of hashed features, n-gram lengths in characters, training rounds, weights of a model at most.
BUCKETS, GRAMS, ROUNDS, WEIGHTS = 1 << 18, (1, 2, 3), 40, 1 << 25
#: Characters that a worker takes up at a time, words of a forward-backward run, words whose features are found at once.
SLICE, RUN, CHUNK = 4_000_000, 300_000, 20_000
UNKNOWN = "und"

_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
PREDICTION = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
LABELS = T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("p", T.DoubleType())]))


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def features(vocabulary: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all words end to end, and the place where each word's begin."""
    coded = [f"\x02{w}\x03" for w in vocabulary]
    flat = np.frombuffer("".join(coded).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    size = np.array([len(c) for c in coded])
    ends = np.cumsum(size)
    owner = np.repeat(np.arange(len(coded)), size)
    left = np.repeat(ends, size) - np.arange(len(flat))
    own, code = [], []
    rolling = np.zeros(len(flat), dtype=np.uint64)
    for n in range(1, max(GRAMS) + 1):
        rolling[: len(flat) - n + 1] = rolling[: len(flat) - n + 1] * np.uint64(0x100000001B3) + flat[n - 1 :]
        if n in GRAMS:
            at = np.flatnonzero(left >= n)
            own.append(owner[at])
            code.append(rolling[at] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n))
    # A word's identity: a hash of all its characters by place.
    power = flat * (np.uint64(0xD6E8FEB86659FD93) ** (left.astype(np.uint64) % np.uint64(61)) | np.uint64(1))
    whole = np.add.reduceat(power, ends - size) if len(coded) else np.empty(0, dtype=np.uint64)
    own.append(np.arange(len(coded)))
    code.append(whole * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(99))
    own, code = np.concatenate(own), np.concatenate(code)
    order = np.argsort(own, kind="stable")
    code ^= code >> np.uint64(32)
    return (code[order] % np.uint64(buckets)).astype(np.int64), np.searchsorted(own[order], np.arange(len(coded)))


class Model:
    """Labels, feature weights, transition scores and start scores."""

    def __init__(self, langs: list[str], weights: np.ndarray, moves: np.ndarray, start: np.ndarray):
        self.langs, self.weights, self.moves, self.start = langs, weights, moves, start

    def scores(self, vocabulary: list[str]) -> np.ndarray:
        """Label scores of words, by the sum of their features' weights."""
        out = np.zeros((len(vocabulary), len(self.langs)))
        for at in range(0, len(vocabulary), CHUNK):
            codes, begins = features(vocabulary[at : at + CHUNK], len(self.weights))
            out[at : at + CHUNK] = np.add.reduceat(self.weights[codes], begins, axis=0)
        return out

    def marginals(self, texts: Iterable[list[str]]):
        """(places of texts, their lengths in words, label probabilities of their words end to end), run by run.

        Texts of like length run together.  Words are numbered as they come, so only
        distinct ones are held.
        """
        number: dict[str, int] = {}
        chains = [np.array([number.setdefault(w, len(number)) for w in ws], dtype=np.int32) for ws in texts]
        sizes = np.array([len(c) for c in chains], dtype=np.int64)
        order = np.argsort(-sizes, kind="stable")
        order = order[sizes[order] > 0]
        if not len(order):
            return
        table, done = self.scores(list(number)), np.cumsum(sizes[order])
        at = 0
        while at < len(order):
            end = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + RUN, side="right")))
            run = order[at:end]
            yield run, sizes[run], self._run(table[np.concatenate([chains[i] for i in run])], sizes[run])
            at = end

    def _run(self, scores: np.ndarray, sizes: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
        """Forward-backward over chains in order of falling length, all at one step together.

        The expected transitions are added to ``pairs``.
        """
        active = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")  # chains longer than t
        begin = np.concatenate(([0], np.cumsum(active)))
        step = np.arange(len(scores)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        place = begin[step] + np.repeat(np.arange(len(sizes)), sizes)
        emit = np.empty_like(scores)
        emit[place] = np.exp(scores - scores.max(axis=1, keepdims=True))
        move, spans = np.exp(self.moves), list(zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True))
        ahead = np.empty_like(emit)
        s, e = spans[0]
        now = emit[s:e] * np.exp(self.start)
        ahead[s:e] = now = now / now.sum(axis=1, keepdims=True)
        for s, e in spans[1:]:
            now = (now[: e - s] @ move) * emit[s:e]
            now /= now.sum(axis=1, keepdims=True)
            ahead[s:e] = now
        s, e = spans[-1]
        back = np.ones((e - s, emit.shape[1]))
        for (ps, pe), (s, e) in zip(spans[-2::-1], spans[:0:-1], strict=True):
            grown = np.ones((pe - ps, emit.shape[1]))
            later = emit[s:e] * back
            grown[: e - s] = later @ move.T
            if pairs is not None:
                first = ahead[ps : ps + e - s]
                pairs += move * ((first / (first * grown[: e - s]).sum(axis=1, keepdims=True)).T @ later)
            grown /= grown.sum(axis=1, keepdims=True)
            back = grown
            ahead[ps:pe] *= back
        ahead /= ahead.sum(axis=1, keepdims=True)
        return ahead[place]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.langs:
            return langs, scores
        for part in slices(texts):
            for run, sizes, p in self.marginals(map(words, texts[part])):
                mean = np.add.reduceat(p, np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
                best = mean.argmax(axis=1)
                for i, b, x in zip(run.tolist(), best.tolist(), mean[np.arange(len(run)), best].tolist(), strict=True):
                    langs[part.start + i], scores[part.start + i] = self.langs[b], min(x, 1.0)
        return langs, scores


def slices(texts: list[str | None]):
    """Ranges of texts of about SLICE characters in all, or of one longer text."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > SLICE:
            yield slice(begin, i)
            begin, size = i, 0
        size += len(t or "")
    yield slice(begin, len(texts))


class Chains:
    """Training chains in order of falling length, with their gold labels."""

    def __init__(self, pieces: list[tuple[int, list[str]]], labels: int, buckets: int):
        chains, golds = _switched(pieces)
        order = np.argsort([-len(c) for c in chains], kind="stable")
        chains, golds = [chains[i] for i in order], [golds[i] for i in order]
        vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for c in chains for w in c))}
        self.codes, self.begins = features(list(vocabulary), buckets)
        self.counts = np.diff(np.concatenate((self.begins, [len(self.codes)])))
        self.index = np.array([vocabulary[w] for c in chains for w in c])
        self.gold, self.sizes = np.concatenate(golds), np.array([len(c) for c in chains])
        self.first = np.cumsum(self.sizes) - self.sizes
        follows = np.ones(len(self.index), dtype=bool)
        follows[self.first] = False
        later = np.flatnonzero(follows)
        self.onehot, self.moves = np.eye(labels), np.zeros((labels, labels))
        np.add.at(self.moves, (self.gold[later - 1], self.gold[later]), 1)

    def gradients(self, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the chains' log-likelihood by weights, transitions and starts: gold counts less expected ones."""
        scores, expected = np.add.reduceat(model.weights[self.codes], self.begins, axis=0)[self.index], np.zeros_like(self.moves)
        p = model._run(scores, self.sizes, expected)
        error = self.onehot[self.gold] - p
        labels = range(len(self.onehot))
        by_word = np.column_stack([np.bincount(self.index, weights=error[:, c], minlength=len(self.counts)) for c in labels])
        by_code = np.column_stack([np.bincount(self.codes, weights=np.repeat(by_word[:, c], self.counts), minlength=len(model.weights)) for c in labels])
        return by_code, self.moves - expected, error[self.first].sum(axis=0)


def train(pieces: list[tuple[str, list[str]]], rounds: int = ROUNDS, rate: float = 0.1, decay: float = 1e-4) -> Model:
    """Fit to pieces of words with one language each, by gradient ascent on the chains' likelihood."""
    langs = sorted({lang for lang, ws in pieces if ws})
    k = len(langs)
    buckets = min(BUCKETS, 1 << max(8, (WEIGHTS // max(k, 1)).bit_length() - 1))
    if not k:
        return Model([], np.zeros((buckets, 0), dtype=np.float32), np.zeros((0, 0)), np.zeros(0))
    number = {lang: i for i, lang in enumerate(langs)}
    chains = Chains([(number[lang], ws) for lang, ws in pieces if ws], k, buckets)
    model = Model(langs, np.zeros((buckets, k)), np.zeros((k, k)), np.zeros(k))
    parameters = (model.weights, model.moves, model.start)
    memory = [np.full_like(x, 1e-8) for x in parameters]
    for _ in range(rounds):
        weights, moves, start = chains.gradients(model)
        gradients = (weights / len(chains.index) - decay * model.weights / buckets, moves / len(chains.index), start / len(chains.first))
        for x, g, m in zip(parameters, gradients, memory, strict=True):
            m += g * g
            x += rate * g / np.sqrt(m)
    return Model(langs, model.weights.astype(np.float32), model.moves, model.start)


def _switched(pieces: list[tuple[int, list[str]]]) -> tuple[list[list[str]], list[np.ndarray]]:
    """Chains of one piece, and chains of halves of two pieces, in an order fixed by seed."""
    rng = np.random.default_rng(4)
    chains = [(ws, np.full(len(ws), k)) for k, ws in pieces]
    order = rng.permutation(len(pieces))
    for i, j in zip(order[::2].tolist(), order[1::2].tolist(), strict=False):
        (a, one), (b, two) = pieces[i], pieces[j]
        one, two = one[: (len(one) + 1) // 2], two[len(two) // 2 :]
        chains.append((one + two, np.concatenate([np.full(len(one), a), np.full(len(two), b)])))
    return [c for c, _ in chains], [g for _, g in chains]


def fit(labelled: DataFrame, *, text: str = "text", lang: str = "lang", docs: int = DOCS, piece: int = PIECE) -> Model:
    """Fit on the labelled documents given; the caller leaves out those to be held out."""
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter("lang is not null and text is not null")
    chance = F.xxhash64("text", F.lit(4)).bitwiseAND(F.lit((1 << 53) - 1))
    texts = rows.select("lang", chance.alias("chance")).groupBy("lang", "chance").agg(F.count("*").alias("copies"))
    # One row for each language.
    rates = texts.groupBy("lang").agg(F.least(F.lit(1.0), 2.0 * docs / F.count("*")).alias("rate"))
    # Twice as many texts as wanted by rate, then exactly by rank: copies of a text count once in both.
    likely = rows.withColumn("chance", chance).join(F.broadcast(rates), "lang").filter(F.col("chance") / float(1 << 53) < F.col("rate")).dropDuplicates(["lang", "chance"])

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def own_words(texts: pa.Array) -> pa.Array:
        return pa.array([words(t.as_py()) for t in texts], pa.list_(pa.string()))

    ranked = likely.select("lang", "chance", "text").withColumn("rank", F.expr("row_number() over (partition by lang order by chance)")).filter(F.col("rank") <= docs)
    found = sorted((r["lang"], r["chance"], r["words"]) for r in ranked.select("lang", "chance", F.array_join(own_words("text"), " ").alias("words")).collect())
    pieces = []
    for name, _, joined in found:
        own = joined.split()
        pieces += [(name, own[at : at + piece]) for at in range(0, len(own), piece)]
    return train(pieces)


def predict(docs: DataFrame, model: Model, *, text: str = "text", into: str = "language") -> DataFrame:
    """``docs`` with a struct ``into``: lang_pred and score."""
    # The model has WEIGHTS weights at most.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(PREDICTION)
    def run(texts: pa.Array) -> pa.Array:
        langs, scores = shared.value.predict(texts.to_pylist())
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=PREDICTION.names)

    return docs.withColumn(into, run(F.col(text)))


def label_words(docs: DataFrame, model: Model, *, text: str = "text", into: str = "labels") -> DataFrame:
    """``docs`` with an array of (word, lang, p) in text order: the most probable language of each word."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(LABELS)
    def run(texts: pa.Array) -> pa.Array:
        own, out = shared.value, []
        for t in texts:
            ws = words(t.as_py()) if own.langs else []
            out.append([])
            for _, _, p in own.marginals([ws]):
                out[-1] += [{"word": w, "lang": own.langs[b], "p": float(q[b])} for w, q, b in zip(ws, p, p.argmax(axis=1), strict=True)]
        return pa.array(out, pa.list_(pa.struct([("word", pa.string()), ("lang", pa.string()), ("p", pa.float64())])))

    return docs.withColumn(into, run(F.col(text)))
