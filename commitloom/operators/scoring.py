"""Probabilities of a calibrated linear model, the best labels, and what path rules make of them.

A row's probabilities are one array in the order of the classes, and its best labels are chosen in the row:
nothing is shuffled for them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commitloom.functions.text import let


@dataclass
class Sparse:
    """Sparse rows: where each one's elements begin (and the last one's end), their places and values."""

    starts: np.ndarray
    at: np.ndarray
    value: np.ndarray

    @staticmethod
    def of(indices: pa.Array, values: pa.Array) -> Sparse:
        """Of two columns of arrays; null rows are empty."""
        sizes = indices.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = lambda a: a.flatten().to_numpy(zero_copy_only=False)
        return Sparse(np.r_[0, np.cumsum(sizes)].astype(np.int64), flat(indices).astype(np.int64), flat(values).astype(float))

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))

    def taken(self, rows: np.ndarray) -> Sparse:
        sizes = np.diff(self.starts)[rows]
        starts = np.r_[0, np.cumsum(sizes)]
        at = np.arange(starts[-1]) + np.repeat(self.starts[rows] - starts[:-1], sizes)
        return Sparse(starts, self.at[at], self.value[at])

    def times(self, w: np.ndarray) -> np.ndarray:
        """Each row's product with w."""
        return np.bincount(self.owner, w[self.at] * self.value, len(self.starts) - 1)

    def back(self, r: np.ndarray, width: int) -> np.ndarray:
        """The sum of the rows, each times its element of r."""
        return np.bincount(self.at, r[self.owner] * self.value, width)


@dataclass
class Fold:
    coef: np.ndarray
    intercept: np.ndarray
    a: np.ndarray
    b: np.ndarray


@dataclass
class Model:
    classes: list[str]
    folds: list[Fold]

    def probabilities(self, x: Sparse) -> np.ndarray:
        """Of sparse rows: margins, a sigmoid of each, each fold's sum made 1 where it isn't 0, and the folds' mean."""
        total = np.zeros((len(x.starts) - 1, len(self.classes)))
        for fold in self.folds:
            margin = np.stack([x.times(w) for w in fold.coef], axis=1) + fold.intercept if len(fold.coef) else total
            with np.errstate(over="ignore"):
                p = 1 / (1 + np.exp(fold.a * margin + fold.b))
            sums = p.sum(axis=1, keepdims=True)
            total += np.divide(p, sums, out=p.copy(), where=sums > 0)
        return total / max(1, len(self.folds))


def score(features: DataFrame, model: Model, key: str = "seq") -> DataFrame:
    """key, probs (in order of the model's classes) of rows with indices and values, in Arrow batches."""

    def run(batches):
        for batch in batches:
            probs = model.probabilities(Sparse.of(batch.column("indices"), batch.column("values")))
            ends = pa.array(np.arange(len(probs) + 1) * len(model.classes), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.ListArray.from_arrays(ends, pa.array(probs.ravel()))], names=[key, "probs"])

    return features.select(key, "indices", "values").mapInArrow(run, features.select(key).schema.add("probs", T.ArrayType(T.DoubleType())))


def _name(classes: list[str], at: Column) -> Column:
    return F.get(F.array(*map(F.lit, classes)), at)


def long_form(probs: DataFrame, classes: list[str], key: str = "seq") -> DataFrame:
    """key, class_idx, label, prob: a row for each class."""
    return probs.select(key, F.posexplode("probs").alias("class_idx", "prob")).select(key, "class_idx", _name(classes, F.col("class_idx")).alias("label"), "prob")


def best(probs: Column, classes: list[str], k: int) -> Column:
    """The k best classes of an array of probabilities (one at least): structs class_idx, label, prob, ties to the lower class index."""
    ranked = F.array_sort(F.transform(probs, lambda p, i: F.struct((-p).alias("less"), i.alias("class_idx"))))
    return F.transform(F.slice(ranked, 1, max(k, 1)), lambda x: F.struct(x["class_idx"].alias("class_idx"), _name(classes, x["class_idx"]).alias("label"), (-x["less"]).alias("prob")))


def top_k(probs: DataFrame, classes: list[str], k: int = 3, key: str = "seq") -> DataFrame:
    """key, class_idx, label, prob, rank (from 1) of the k best labels of each row with ``probs``."""
    return probs.select(key, F.posexplode(best(F.col("probs"), classes, k)).alias("at", "x")).select(key, "x.*", (F.col("at") + 1).alias("rank"))


def predict(probs: DataFrame, classes: list[str], key: str = "seq") -> DataFrame:
    """key, label of the best class."""
    return probs.select(key, best(F.col("probs"), classes, 1)[0]["label"].alias("label"))


def softmax(margins: Column) -> Column:
    """Of an array of margins, shifted by the largest; a single margin m stands for (-m, m)."""
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda s, y: s + y)
    powers = lambda m: let(F.array_max(m), lambda top: F.transform(m, lambda x: F.exp(x - top)))
    both = F.when(F.size(margins) == 1, F.array(-margins[0], margins[0])).otherwise(margins)
    return let(let(both, powers), lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)))


def preselect(probs: DataFrame, classes: list[str], hits: DataFrame, k: int = 3, key: str = "seq") -> DataFrame:
    """key, label, chosen_rank: the path rule's label (``hit``, of one row of ``hits`` for each key) where it is among the k best, else the best."""
    rows = probs.select(key, best(F.col("probs"), classes, k).alias("_best")).join(hits.select(key, "hit"), key, "left")
    place = F.coalesce(F.nullif(F.array_position(F.transform("_best", lambda x: x["label"]), F.col("hit")), F.lit(0)), F.lit(1)).cast("int")
    return rows.select(key, "_best", place.alias("chosen_rank")).select(key, F.element_at("_best", F.col("chosen_rank"))["label"].alias("label"), "chosen_rank")


def short_circuit(probs: DataFrame, classes: list[str], hits: DataFrame, k: int = 3, key: str = "seq") -> DataFrame:
    """key, label, prob, rank by the older rule: where a path rule hits, its label alone with probability 1, else the k best labels."""
    rows = probs.select(key, best(F.col("probs"), classes, k).alias("_best")).join(hits.select(key, "hit"), key, "left")
    alone = F.array(F.struct(F.lit(-1).alias("class_idx"), F.col("hit").alias("label"), F.lit(1.0).alias("prob")))
    chosen = F.when(F.col("hit").isNotNull(), alone).otherwise(F.col("_best"))
    return rows.select(key, F.posexplode(chosen).alias("at", "x")).select(key, "x.label", "x.prob", (F.col("at") + 1).alias("rank"))
