"""Toxicity by a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

A document's features count, for each hashed n-gram, its different words that have it. Each feature is
scaled by the log ratio of how often it occurs in toxic and in other documents, and logistic regression
learns the weights. As a score is a sum over a document's different words, each word's part is kept by a
bounded cache.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitloom.llm import common, wordgrams

#: Labelled documents that a model is fitted to, at most.
TRAIN_DOCS = 6_000
SIZES, BITS = (3, 4, 5), 18
#: Counts added to both classes, in proportion to their sizes; steps, rate and shrinkage of the regression.
SMOOTH, STEPS, RATE, SHRINK = 20.0, 60, 0.05, 10.0


#: Words whose features are made at once in training.
WORDS_AT_ONCE = 10_000


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def train(samples: list[tuple[str, int]]) -> Model:
    """A model of (text, 0 or 1) samples. With one class only, all scores are that class's share (within 0.01 to 0.99)."""
    y = np.array([label for _, label in samples], float)
    n = len(y)
    share = float(np.clip(y.mean(), 0.01, 0.99)) if n else 0.01
    bias = float(np.log(share / (1 - share)))
    if not n or y.min() == y.max():
        return Model(np.zeros((2**BITS, 1), np.float32), bias)
    names: dict[str, int] = {}
    docs, words = [], []
    for i, (text, _) in enumerate(samples):
        own = sorted(set(wordgrams.words_of(text)))
        docs.append(np.full(len(own), i, np.int32))
        words.append(np.array([names.setdefault(w, len(names)) for w in own], np.int32))
    if not names:
        return Model(np.zeros((2**BITS, 1), np.float32), bias)
    doc, word = np.concatenate(docs), np.concatenate(words)
    # some words at a time, which bounds the driver's memory: features are kept in the smallest numbers that hold them
    every_word, parts = list(names), []
    for at in range(0, len(every_word), WORDS_AT_ONCE):
        own = every_word[at : at + WORDS_AT_ONCE]
        of, feature = wordgrams.hashed(own, SIZES, BITS)
        parts.append((slice(at, at + len(own)), of.astype(np.int16), feature.astype(np.int32)))
    size = len(names)
    del every_word, names, docs, words
    cells = 2**BITS

    def spread(by_word: np.ndarray) -> np.ndarray:
        """For each feature the sum of its words' numbers, in the order of all words."""
        total = np.zeros(cells)
        for some, of, feature in parts:
            np.add.at(total, feature, by_word[some][of])
        return total

    ones = spread(np.bincount(word, y[doc], size))
    every = spread(np.bincount(word, minlength=size).astype(float))
    rate = ones.sum() / every.sum()
    ratio = np.log((ones + SMOOTH * rate) / (every - ones + SMOOTH * (1 - rate))) - np.log(rate / (1 - rate))
    w, velocity, square = np.zeros(cells), np.zeros(cells), np.zeros(cells)
    part = np.zeros(size)
    for step in range(1, STEPS + 1):
        scaled = ratio * w
        for some, of, feature in parts:
            part[some] = np.bincount(of, scaled[feature], len(part[some]))
        z = np.bincount(doc, part[word], n) + bias
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        grad = ratio * spread(np.bincount(word, error[doc], size)) / n + SHRINK * w / n
        velocity, square = 0.9 * velocity + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        w -= RATE * (velocity / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-6)
        bias -= RATE * 5 * error.mean()
    return Model((ratio * w).astype(np.float32)[:, None], float(bias))


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, float] = {}

    def __call__(self, texts: list[str]) -> list[float]:
        if len(self.known) > common.CACHE_WORDS:
            self.known = {}
        cut = [set(wordgrams.words_of(t)) for t in texts]
        known = self.known
        new = list({w for words in cut for w in words if w not in known})
        known.update(zip(new, wordgrams.sums(new, self.model.weights, SIZES)[:, 0].tolist(), strict=True))
        # sorted, so that equal texts have equal scores whatever came before
        z = np.array([sum(sorted([known[w] for w in words])) for words in cut]) + self.model.bias
        return (1 / (1 + np.exp(-np.clip(z, -30, 30)))).tolist()


def different_words(batches):
    """Each text as its different words, which are all that a model sees of it."""
    for batch in batches:
        for block in common.blocks(batch):
            cut = [" ".join(sorted(set(wordgrams.words_of(t)))) for t in common.texts(block)]
            yield block.set_column(block.schema.get_field_index("text"), "text", pa.array(cut, pa.string()))


def fit(docs: DataFrame, labels: DataFrame, salt: int = 9) -> Model:
    """A model of at most TRAIN_DOCS of the documents (doc_id, text) that ``labels`` (doc_id, toxic) covers.

    Null texts, ids and labels are left out; of several labels of a document the largest counts, and of several
    texts of an id one. Whole texts count, but only their different words reach the driver.
    """
    chosen = common.sample(labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")), TRAIN_DOCS, salt)
    taught = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")
    rows = common.one_of_each(taught.mapInArrow(different_words, taught.schema)).collect()
    return train([(r.text, int(r.toxic > 0)) for r in sorted(rows, key=lambda r: (r.doc_id, r.text))])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of ``docs`` (doc_id, text and any others but the added one), with score.

    Null and empty texts get the score of a text without words. Whole texts are read, however long.
    Repeated rows give repeated results; an empty table none.
    """
    names = [c for c in docs.columns if c != "score"]

    def make():
        scorer = Scorer(model)

        def work(block):
            return pa.RecordBatch.from_arrays([*block.columns, pa.array(scorer(common.texts(block)), pa.float64())], names=[*block.schema.names, "score"])

        return work

    return docs.select(*names).mapInArrow(common.by_block(make), docs.select(*names).schema.add("score", "double"))
