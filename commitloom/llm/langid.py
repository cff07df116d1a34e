"""Language identification by a linear-chain conditional random field over words.

A word's score for each language is the sum of weights of its affixes and n-grams (hashed) and of its
place in learned lexicons; learned transitions say how likely neighbouring words differ. Forward-backward
gives every word's distribution, and a document's language is the one with the largest mean (of equal ones
the first by name). Whole texts of the sampled documents are cut into spans; training sequences are two
spans joined, mostly of different documents, so switches are seen.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitloom.llm import common, wordgrams

#: Labelled documents that a model is fitted to, at most, each with its whole text; and words of a span of them.
TRAIN_DOCS, SPAN = 1_000, 30
SIZES, BITS = (2, 3, 4), 16
EPOCHS, BATCH, RATE, SHRINK = 4, 32, 0.2, 1e-6
#: Words that so many of a language's spans hold form its lexicon.
LEXICON = 3
#: The pipeline keeps a document whose language has this mean probability, or whose words, each in the language
#: that it fits best, have a mean probability of LEAST_FIT: clean text of several languages has no large share of one.
LEAST_SCORE, LEAST_FIT = 0.4, 0.7
#: Characters of a block, about: marginals of all its words are held at a time.
BLOCK_CHARS = 1_000_000
#: Words of a document that are walked through one after another; the walks of different stretches run side by side.
STRETCH = 32


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    lexicons: list[set[str]]
    lexicon_weights: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        inside = np.array([[w in lexicon for lexicon in self.lexicons] for w in words], float).reshape(len(words), len(self.langs))
        return wordgrams.sums(words, self.weights, SIZES) + inside @ self.lexicon_weights


def forward_backward(emissions: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (sequence, place, label) of equally long sequences, and expected transitions (summed)."""
    n, t, k = emissions.shape
    a, u = np.exp(transitions), np.exp(emissions - emissions.max(axis=2, keepdims=True))
    alpha, beta = np.empty((n, t, k)), np.empty((n, t, k))
    now = np.full((n, k), 1 / k)
    for i in range(t):
        now = (now @ a) * u[:, i]
        now /= now.sum(axis=1, keepdims=True)
        alpha[:, i] = now
    now = np.ones((n, k))
    for i in reversed(range(t)):
        beta[:, i] = now
        now = (now * u[:, i]) @ a.T
        now /= now.sum(axis=1, keepdims=True)
    gamma = alpha * beta
    gamma /= gamma.sum(axis=2, keepdims=True)
    start = np.full((n, 1, k), 1 / k)
    left, right = np.concatenate([start, alpha[:, :-1]], axis=1), u * beta
    pairs = left[..., :, None] * a * right[..., None, :]
    return gamma, (pairs / pairs.sum(axis=(2, 3), keepdims=True)).sum(axis=(0, 1))


def spans_of(words: np.ndarray) -> np.ndarray:
    """Rows of SPAN words that cover a text: evenly spaced, overlapping where the length isn't a multiple; a shorter text is repeated."""
    if len(words) <= SPAN:
        return np.resize(words, (min(1, len(words)), SPAN))
    n = -(-len(words) // SPAN)
    return words[np.arange(n)[:, None] * (len(words) - SPAN) // (n - 1) + np.arange(SPAN)]


def train(samples: list[tuple[str, str]], seed: int = 7) -> Model:
    """A model of (text, language) samples, all words of which it sees in every epoch; without any it knows no language."""
    langs = sorted({lang for _, lang in samples})
    k = len(langs)
    rng = np.random.default_rng(seed)
    names: dict[str, int] = {}
    parts = [spans_of(np.array([names.setdefault(w, len(names)) for w in wordgrams.words_of(text)], np.int32)) for text, _ in samples]
    spans = np.concatenate([np.zeros((0, SPAN), np.int32), *parts])
    labels = np.repeat([langs.index(lang) for _, lang in samples], [len(p) for p in parts]).astype(int)
    held = np.zeros((len(names), k), np.int64)
    for i in range(0, len(spans), 10_000):
        block = np.sort(spans[i : i + 10_000], axis=1)
        first = np.diff(block, axis=1, prepend=-1) != 0
        np.add.at(held, (block[first], np.repeat(labels[i : i + 10_000], first.sum(axis=1))), 1)
    inside = (held >= LEXICON).astype(float)
    words = list(names)
    lexicons = [{words[i] for i in np.flatnonzero(inside[:, j])} for j in range(k)]
    model = Model(langs, np.zeros((2**BITS, k)), np.zeros((k, k)), lexicons, np.zeros((k, k)))
    if k < 2 or not len(spans):
        return model
    of, feature = wordgrams.hashed(words, SIZES, BITS)
    order = np.argsort(of, kind="stable")
    feature, bounds = feature[order], np.searchsorted(of[order], np.arange(len(names) + 1))
    squares = [np.full(x.shape, 1e-6) for x in (model.weights, model.transitions, model.lexicon_weights)]

    def step(x: np.ndarray, square: np.ndarray, grad: np.ndarray, at=slice(None)) -> None:
        square[at] += grad**2
        x[at] += RATE * (grad - SHRINK * x[at]) / np.sqrt(square[at])

    for _ in range(EPOCHS):
        # every span once; with an odd number of them the first one twice
        pairs_of = np.resize(rng.permutation(len(spans)), (-(-len(spans) // 2), 2))
        for at in range(0, len(pairs_of), BATCH):
            chosen = pairs_of[at : at + BATCH]
            ids, ys = spans[chosen].reshape(len(chosen), -1), np.repeat(labels[chosen], SPAN, axis=1)
            used, back = np.unique(ids, return_inverse=True)
            back = back.reshape(ids.shape)
            sizes = bounds[used + 1] - bounds[used]
            spots = np.concatenate([feature[bounds[x] : bounds[x + 1]] for x in used])
            owner = np.repeat(np.arange(len(used)), sizes)
            scores = np.stack([np.bincount(owner, model.weights[spots, j], len(used)) for j in range(k)], axis=1) + inside[used] @ model.lexicon_weights
            gamma, pairs = forward_backward(scores[back], model.transitions)
            want = np.eye(k)[ys]
            seen = np.zeros((k, k))
            np.add.at(seen, (ys[:, :-1].ravel(), ys[:, 1:].ravel()), 1)
            seen += want[:, 0].sum(axis=0) / k
            error = (want - gamma).reshape(-1, k)
            by_word = np.stack([np.bincount(back.ravel(), error[:, j], len(used)) for j in range(k)], axis=1)
            cells, cell = np.unique(spots, return_inverse=True)
            grad = np.stack([np.bincount(cell, by_word[owner, j], len(cells)) for j in range(k)], axis=1)
            step(model.weights, squares[0], grad, cells)
            step(model.transitions, squares[1], seen - pairs)
            step(model.lexicon_weights, squares[2], inside[used].T @ by_word)
    model.weights = model.weights.astype(np.float32)
    return model


def mean_marginals(u: np.ndarray, transitions: np.ndarray, word: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Mean marginals of each document, see ``means_and_fits``."""
    return means_and_fits(u, transitions, word, sizes)[0]


def means_and_fits(u: np.ndarray, transitions: np.ndarray, word: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean marginals of each document, and the mean of its words' largest marginals. u: exp of each word type's scores; word: types of all documents' words; sizes: words of each (at least 1).

    Documents are cut into stretches: the product of each stretch's matrices carries messages past it, so
    that only stretches, and the places in one stretch, are walked one after another. The result is exact.
    """
    k, a = u.shape[1], np.exp(transitions)
    stretches = -(-sizes // STRETCH)
    doc = np.repeat(np.arange(len(sizes)), stretches)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(stretches) - stretches, stretches)
    at = np.repeat(np.cumsum(sizes) - sizes, stretches) + number * STRETCH
    left = np.minimum(np.repeat(sizes, stretches) - number * STRETCH, STRETCH)
    index = at[:, None] + np.arange(STRETCH)
    real = np.arange(STRETCH) < left[:, None]
    types = word[np.minimum(index, len(word) - 1)]
    product = np.tile(np.eye(k), (len(doc), 1, 1))
    for i in range(STRETCH):
        live = real[:, i]
        p = (product[live] @ a) * u[types[live, i]][:, None, :]
        product[live] = p / p.sum(axis=(1, 2), keepdims=True)
    first, last = np.empty((len(doc), k)), np.empty((len(doc), k))
    ends = np.cumsum(stretches)
    starts = ends - stretches
    many = np.argsort(-stretches, kind="stable")
    counts = stretches[many]
    now, then = np.full((len(sizes), k), 1 / k), np.ones((len(sizes), k))
    for j in range(int(stretches.max(initial=0))):
        docs = many[: np.searchsorted(-counts, -j, "left")]
        f, b = starts[docs] + j, ends[docs] - 1 - j
        first[f], last[b] = now[docs], then[docs]
        x = np.einsum("di,dij->dj", now[docs], product[f])
        y = np.einsum("dij,dj->di", product[b], then[docs])
        now[docs], then[docs] = x / x.sum(axis=1, keepdims=True), y / y.sum(axis=1, keepdims=True)
    alpha = np.empty((len(doc), STRETCH, k))
    now = first
    for i in range(STRETCH):
        x = (now @ a) * u[types[:, i]]
        now = np.where(real[:, i, None], x / x.sum(axis=1, keepdims=True), now)
        alpha[:, i] = now
    total, largest, now = np.zeros((len(doc), k)), np.zeros(len(doc)), last
    for i in reversed(range(STRETCH)):
        live = real[:, i, None]
        g = alpha[:, i] * now
        g = np.where(live, g / g.sum(axis=1, keepdims=True), 0)
        total += g
        largest += g.max(axis=1)
        x = (now * u[types[:, i]]) @ a.T
        now = np.where(live, x / x.sum(axis=1, keepdims=True), now)
    return np.stack([np.bincount(doc, total[:, j], len(sizes)) for j in range(k)], axis=1) / sizes[:, None], np.bincount(doc, largest, len(sizes)) / sizes


class Predictor:
    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, int] = {}
        self.u = np.empty((0, len(model.langs)))

    def __call__(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """The language of each text and its mean probability; ``und`` and 0 without a letter or a learned language."""
        return self.fitted(texts)[:2]

    def fitted(self, texts: list[str]) -> tuple[list[str], list[float], list[float]]:
        """What calling gives, and the mean over words of the probability of the language that each fits best; 0 for ``und``."""
        if len(self.known) > common.CACHE_WORDS:
            self.known, self.u = {}, self.u[:0]
        cut = [wordgrams.words_of(t) for t in texts]
        known = self.known
        new = [w for w in dict.fromkeys(w for words in cut for w in words) if w not in known]
        if new and self.model.langs:
            scores = self.model.emissions(new)
            self.u = np.concatenate([self.u, np.exp(np.maximum(scores - scores.max(axis=1, keepdims=True), -30))])
            for w in new:
                known[w] = len(known)
        langs, out, fits = ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        some = [i for i, words in enumerate(cut) if words and any(map(str.isalpha, texts[i]))] if self.model.langs else []
        if some:
            sizes = np.array([len(cut[i]) for i in some])
            word = np.fromiter((known[w] for i in some for w in cut[i]), np.int64, int(sizes.sum()))
            means, largest = means_and_fits(self.u, self.model.transitions, word, sizes)
            for i, j, m, fit in zip(some, means.argmax(axis=1), means, largest, strict=True):
                langs[i], out[i], fits[i] = self.model.langs[j], float(min(1.0, m[j])), float(min(1.0, fit))
        return langs, out, fits


def fit(docs: DataFrame, salt: int = 4) -> Model:
    """A model of at most TRAIN_DOCS of the rows of ``docs`` (doc_id, text, lang) that have a text and a lang.

    Their whole texts reach the driver; rows of equal doc_id count as one.
    """
    labelled = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    rows = common.sample(labelled, TRAIN_DOCS, salt).collect()
    return train([(r.text, r.lang) for r in sorted(rows, key=lambda r: (r.doc_id, r.text, r.lang))])


def identify(docs: DataFrame, model: Model, fit: bool = False) -> DataFrame:
    """The columns of ``docs`` (doc_id, text and any others but those added), with lang_pred and score; and fit if asked for.

    Texts that are null or without a letter are ``und`` with score (and fit) 0; so are all if the model knows no
    language. Of languages with equal means the first by name is chosen. Whole texts are read, however long. Repeated rows give repeated results; an empty table none.
    """
    added = ["lang_pred", "score", *(["fit"] if fit else [])]
    names = [c for c in docs.columns if c not in added]

    def make():
        predict = Predictor(model)

        def work(block):
            langs, scores, fits = predict.fitted(common.texts(block))
            more = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(fits, pa.float64())][: len(added)]
            return pa.RecordBatch.from_arrays([*block.columns, *more], names=[*block.schema.names, *added])

        return work

    schema = docs.select(*names).schema.add("lang_pred", "string").add("score", "double")
    return docs.select(*names).mapInArrow(common.by_block(make, most=BLOCK_CHARS), schema.add("fit", "double") if fit else schema)
