"""Fitting the calibrated linear classifier: one-vs-rest support vectors in three folds, each with Platt scaling.

Labelled rows stay where they are, as sparse blocks in partitions. All problems, one for each class of each fold,
are solved together by Newton steps: each pass over the blocks sums gradients, or products of directions with the
second derivative, of all problems that are still open, by a tree of partial sums. What is sent to the tasks and
what comes back are vectors of features for each problem, whose size is the model's and not the data's.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitloom import scratch
from commitloom.operators.evaluation import shuffled
from commitloom.operators.firsts import with_place
from commitloom.operators.scoring import Fold, Model, Sparse

#: Fixed value: folds of the calibration.
FOLDS = 3
#: The seed of the order that deals rows out to folds.
SEED = 42
#: A solution's gradient is at most this share of the first one's.
TOLERANCE = 1e-9
#: Elements of a block of rows, and of the blocks of a task, about (one row at least).
BLOCK_VALUES, TASK_VALUES = 50_000, 250_000
#: A feature that one of so many rows of a block has is one of its dense matrix's columns.
DENSE = 128
#: Bytes of all classes' sums of products of features, for the features that weigh most, about; the share of rows taken to bend the loss.
NEAR_BYTES, BENDING = 32 << 20, 0.3
#: Partial sums that one task, or the driver, adds up, about.
FAN = 16


@dataclass
class Block:
    """Sparse rows with their labels (as numbers) and folds. Every row has the intercept's 1 as its last element.

    Features that one row in DENSE has at least stand in a dense matrix, as most elements are of such; the rest stays
    sparse, by row and by feature.
    """

    rows: Sparse
    label: np.ndarray
    fold: np.ndarray

    def __post_init__(self):
        n, owner = len(self.rows.starts) - 1, self.rows.owner
        times = np.bincount(self.rows.at)
        often = (times > 0) & (times * DENSE >= n)
        self.common, rare = np.flatnonzero(often), ~often[self.rows.at]
        place = (np.cumsum(often) - 1)[self.rows.at]
        # elements of the same row and feature add up
        self.dense = np.bincount(owner[~rare] * len(self.common) + place[~rare], self.rows.value[~rare], n * len(self.common)).reshape(n, -1)
        self.at, self.value, owner = self.rows.at[rare], self.rows.value[rare][:, None], owner[rare]
        self.with_rare, self.begins = np.unique(owner, return_index=True)
        self.order = np.argsort(self.at, kind="stable")
        self.features, self.starts = np.unique(self.at[self.order], return_index=True)
        self.owner = owner[self.order]

    def times(self, w: np.ndarray) -> np.ndarray:
        """(rows, problems): each row's products with vectors of features (features, problems)."""
        out = self.dense @ w[self.common]
        if len(self.at):
            out[self.with_rare] += np.add.reduceat(w[self.at] * self.value, self.begins, axis=0)
        return out

    def back(self, r: np.ndarray, into: np.ndarray) -> None:
        """Adds to (features, problems) the sum of the rows, each times its numbers of ``r`` (rows, problems)."""
        into[self.common] += self.dense.T @ r
        if len(self.at):
            into[self.features] += np.add.reduceat(r[self.owner] * self.value[self.order], self.starts, axis=0)


def with_fold(rows: DataFrame, folds: int = FOLDS, key: str = "seq", seed: int = SEED) -> DataFrame:
    """``rows`` (key, label and others) with fold: each label's different keys are dealt out in turn, in the order of a seeded shuffle.

    Rows of one key and label share a fold.
    """
    keys = rows.select(key, "label").distinct()
    mixed = shuffled(seed, key)
    placed = with_place(keys, "label", F.conv(F.substring(mixed, 1, 3), 16, 10).cast("long"), [mixed, F.col(key)], "_place")
    return rows.join(placed.select(key, "label", ((F.col("_place") - 1) % folds).cast("int").alias("fold")), [key, "label"])


#: Columns of a row of blocks: where rows begin, places, values, labels, folds.
_COLUMNS = {"starts": np.int64, "at": np.int32, "value": np.float64, "label": np.int32, "fold": np.int32}


def _blocks(rows: DataFrame, classes: list[str], width: int) -> DataFrame:
    """Rows (label, fold, indices, values) as a row of arrays for each block."""
    place = {c: i for i, c in enumerate(classes)}

    def run(batches):
        for batch in batches:
            sizes = batch.column("indices").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            label = np.array([place[x] for x in batch.column("label").to_pylist()], np.int32)
            fold = batch.column("fold").to_numpy()
            x = Sparse.of(batch.column("indices"), batch.column("values"))
            # the intercept: one more element at the end of each row
            at = np.insert(x.at, x.starts[1:], width)
            value = np.insert(x.value, x.starts[1:], 1.0)
            x = Sparse(np.r_[0, np.cumsum(sizes + 1)].astype(np.int64), at, value)
            part = x.starts[:-1] // BLOCK_VALUES
            cuts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(part)] if len(part) else np.zeros(1, int)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                y = x.taken(np.arange(a, b))
                columns = zip((y.starts, y.at, y.value, label[a:b], fold[a:b]), _COLUMNS.values(), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([np.asarray(c, t).tobytes()], pa.binary()) for c, t in columns], names=list(_COLUMNS))

    return rows.mapInArrow(run, ", ".join(f"{c} binary" for c in _COLUMNS))


def _block(batch: pa.RecordBatch, i: int) -> Block:
    starts, at, value, label, fold = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in _COLUMNS.items())
    return Block(Sparse(starts, at, value), label, fold)


def _added(totals) -> list[np.ndarray] | None:
    """The sum of what ``totals`` gives, lists of arrays in bytes."""
    out = None
    for total in totals:
        arrays = pickle.loads(total)
        out = arrays if out is None else [x + y for x, y in zip(out, arrays, strict=True)]
    return out


def summed(blocks: DataFrame, sent, part: Callable, large: bool = False) -> list[np.ndarray]:
    """The sum of ``part(sent, block, total)`` over all blocks; ``part`` adds to its total (None at first) and returns a list of arrays.

    Every task gives one sum; FAN of them at a time are added in tasks, until the driver has about FAN to add. Of
    ``large`` sums the driver takes one at a time, for which the last tasks run one after the other.
    """
    spark, n = blocks.sparkSession, blocks.rdd.getNumPartitions()
    shared = spark.sparkContext.broadcast(sent)
    row = lambda total: pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], names=["total"])

    def run(batches):
        total = None
        for batch in batches:
            for i in range(len(batch)):
                total = part(shared.value, _block(batch, i), total)
        if total is not None:
            yield row(total)

    def add(batches):
        total = _added(x.as_py() for batch in batches for x in batch.column("total"))
        if total is not None:
            yield row(total)

    totals = blocks.mapInArrow(run, "total binary")
    while n > FAN:
        n = -(-n // FAN)
        totals = totals.repartition(n).mapInArrow(add, "total binary")
    return _added(r.total for r in (totals.toLocalIterator() if large else totals.collect()))


@dataclass
class Problems:
    """For each problem its fold and class, and what its class's rows weigh in training."""

    fold: np.ndarray
    label: np.ndarray
    weight: np.ndarray

    def taken(self, some: np.ndarray) -> Problems:
        return Problems(self.fold[some], self.label[some], self.weight[some])

    def of(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """(rows, problems): 1 or -1, and the cost of each row in each problem (0 for those of its own fold)."""
        mine = block.label[:, None] == self.label
        return np.where(mine, 1.0, -1.0), np.where(block.fold[:, None] == self.fold, 0.0, np.where(mine, self.weight, 1.0))


def _gradient(sent, block, total):
    """Adds each problem's loss and gradient."""
    problems, w = sent
    loss, gradient = total or (np.zeros(w.shape[1]), np.zeros(w.shape))
    y, cost = problems.of(block)
    slack = np.maximum(0, 1 - y * block.times(w))
    block.back(-2 * cost * y * slack, gradient)
    return [loss + (cost * slack**2).sum(axis=0), gradient]


def _bent(sent, block, total):
    """Adds each problem's product of a direction with the second derivative."""
    problems, w, direction = sent
    (out,) = total or (np.zeros(w.shape),)
    y, cost = problems.of(block)
    block.back(2 * cost * (y * block.times(w) < 1) * block.times(direction), out)
    return [out]


def _shorter(sent, block, total):
    """Adds each problem's losses at several lengths of a step."""
    problems, w, step, lengths = sent
    (out,) = total or (np.zeros((len(lengths), w.shape[1])),)
    y, cost = problems.of(block)
    at, along = block.times(w), block.times(step)
    return [out + np.stack([(cost * np.maximum(0, 1 - y * (at + t * along)) ** 2).sum(axis=0) for t in lengths])]


def _squares(sent, block, total):
    """Adds, of each class, the squares of each feature."""
    width, classes = sent
    (out,) = total or (np.zeros((width, classes)),)
    np.add.at(out, (block.rows.at, block.label[block.rows.owner]), block.rows.value**2)
    return [out]


def _products(sent, block, total):
    """Adds, of each class, the products of each two of some features; ``place`` has each feature's number among them, or -1."""
    place, k, classes = sent
    (out,) = total or (np.zeros((classes, k, k), np.float32),)
    some = place[block.rows.at] >= 0
    x = np.bincount(block.rows.owner[some] * k + place[block.rows.at[some]], block.rows.value[some], len(block.label) * k).reshape(-1, k).astype(np.float32)
    for c in np.unique(block.label):
        mine = x[block.label == c]
        out[c] += mine.T @ mine
    return [out]


@dataclass
class Nearby:
    """What is near the second derivative of each class's problems, inverted: whole for some features, of the others only the diagonal.

    It decides how many passes conjugate gradients take, and nothing of where they end.
    """

    some: np.ndarray
    inverse: np.ndarray
    diagonal: np.ndarray

    @staticmethod
    def of(blocks: DataFrame, problems: Problems, width: int, classes: int) -> Nearby:
        folds = len(np.unique(problems.fold))
        (squares,) = summed(blocks, (width + 1, classes), _squares)
        k = min(width + 1, int(np.sqrt(NEAR_BYTES / 4 / classes)))
        some = np.sort(np.argsort(-squares.sum(axis=1), kind="stable")[:k])
        place = np.full(width + 1, -1)
        place[some] = np.arange(k)
        (products,) = summed(blocks, (place, k, classes), _products, large=True)
        share = 2 * BENDING * max(1, folds - 1) / max(1, folds)
        weight = [problems.weight[problems.label == c].mean() if (problems.label == c).any() else 1.0 for c in range(classes)]
        every, all_squares = products.sum(axis=0, dtype=float), squares.sum(axis=1)
        inverse = np.stack([np.linalg.inv(np.eye(k) + share * (every + (weight[c] - 1) * products[c])) for c in range(classes)])
        diagonal = np.stack([1 + share * (all_squares + (weight[c] - 1) * squares[:, c]) for c in range(classes)], axis=1)
        return Nearby(some, (inverse + inverse.transpose(0, 2, 1)) / 2, diagonal)

    def solved(self, label: np.ndarray, r: np.ndarray) -> np.ndarray:
        """(features, problems), each problem of its class ``label``."""
        out = r / self.diagonal[:, label]
        for c in np.unique(label):
            at = np.ix_(self.some, np.flatnonzero(label == c))
            out[at] = self.inverse[c] @ r[at]
        return out


def support_vectors(blocks: DataFrame, problems: Problems, width: int, classes: int, max_iter: int = 100) -> np.ndarray:
    """(width + 1, problems): coefficients, the intercept last, that minimize |w|^2 / 2 + sum of cost * max(0, 1 - y * (x w))^2.

    The intercept is a coefficient of a feature that is 1 in every row. Newton steps, each solved by conjugate
    gradients and shortened until it descends; the minimum is the only one. What is near the second derivative
    (see Nearby) saves passes. A problem that is solved takes no part in further passes.
    """
    square = lambda v: (v * v).sum(axis=0)
    w = np.zeros((width + 1, len(problems.fold)))
    loss, gradient = summed(blocks, (problems, w), _gradient)
    value, gradient = loss + 0.5 * square(w), gradient + w
    first = np.sqrt(square(gradient))
    near = Nearby.of(blocks, problems, width, classes)
    stuck = np.zeros(len(first), bool)
    for _ in range(max_iter):
        size = np.sqrt(square(gradient))
        open_ = np.flatnonzero((size > TOLERANCE * first) & ~stuck)
        if not len(open_):
            break
        mine = problems.taken(open_)
        step = _newton_step(blocks, near, mine, w[:, open_], gradient[:, open_], size[open_], first[open_])
        slope, now = (gradient[:, open_] * step).sum(axis=0), value[open_]
        t = np.ones(len(open_))
        fits = lambda there, t: there <= now + 1e-4 * t * slope  # noqa: B023, E731
        loss, next_ = summed(blocks, (mine, w[:, open_] + step), _gradient)
        there = loss + 0.5 * square(w[:, open_] + step)
        if not (good := fits(there, t)).all():
            bad = np.flatnonzero(~good)
            lengths = 0.5 ** np.arange(1, 41)
            (losses,) = summed(blocks, (mine.taken(bad), w[:, open_[bad]], step[:, bad], lengths), _shorter)
            losses += 0.5 * np.stack([square(w[:, open_[bad]] + s * step[:, bad]) for s in lengths])
            right = losses <= now[bad] + 1e-4 * lengths[:, None] * slope[bad]
            t[bad] = np.where(right.any(axis=0), lengths[right.argmax(axis=0)], 0)
            stuck[open_[bad]] = t[bad] == 0
            loss, next_ = summed(blocks, (mine, w[:, open_] + t * step), _gradient)
            there = loss + 0.5 * square(w[:, open_] + t * step)
        w[:, open_] += t * step
        value[open_], gradient[:, open_] = there, next_ + w[:, open_]
    return w


def _newton_step(blocks: DataFrame, near: Nearby, problems: Problems, w: np.ndarray, gradient: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Steps by conjugate gradients, one pass for each of their iterations; each problem ends by its own measure."""
    step, left = np.zeros_like(w), -gradient
    direction, square = near.solved(problems.label, left), (left * left).sum(axis=0)
    along = (left * direction).sum(axis=0)
    enough = np.minimum(0.5, np.sqrt(size / first)) * size
    while len(go := np.flatnonzero(np.sqrt(square) > enough)):
        (bent,) = summed(blocks, (problems.taken(go), w[:, go], direction[:, go]), _bent)
        bent += direction[:, go]
        far = along[go] / (direction[:, go] * bent).sum(axis=0)
        step[:, go] += far * direction[:, go]
        left[:, go] -= far * bent
        square[go] = (left[:, go] ** 2).sum(axis=0)
        solved = near.solved(problems.label[go], left[:, go])
        after = (left[:, go] * solved).sum(axis=0)
        direction[:, go] = solved + after / along[go] * direction[:, go]
        along[go] = after
    return step


def _platt_sums(sent, block, total):
    """Adds, of each problem, the loss and the derivatives of a sigmoid at (a, b): loss, two first ones, three second ones.

    A block's margins come from the coefficients of each row's own fold.
    """
    ab, w, folds, high, low = sent
    classes = ab.shape[1]
    out = (total or (np.zeros((6, len(folds), classes)),))[0]
    for i, f in enumerate(folds):
        some = np.flatnonzero(block.fold == f)
        if not len(some):
            continue
        margin = block.times(w[i])[some]
        target = np.where(block.label[some][:, None] == np.arange(classes), (high[i] + 1) / (high[i] + 2), 1 / (low[i] + 2))
        z = ab[i, :, 0] * margin + ab[i, :, 1]
        p = 1 / (1 + np.exp(np.clip(z, -500, 500)))
        q = p * (1 - p) + 1e-12
        out[:, i] += np.stack([x.sum(axis=0) for x in (np.logaddexp(0, z) - (1 - target) * z, (target - p) * margin, target - p, q * margin**2, q * margin, q)])
    return [out]


def platt(blocks: DataFrame, w: np.ndarray, high: np.ndarray, low: np.ndarray, max_iter: int = 100) -> np.ndarray:
    """(folds, classes, 2): a, b of p = 1 / (1 + exp(a * margin + b)) of each problem, on the rows of its own fold.

    ``w``: (folds, width + 1, classes); ``high`` and ``low``: (folds, classes) rows of a class, and other ones, in
    each fold. Newton steps, targets softened by the classes' sizes.
    """
    folds = np.arange(len(w))
    sums = lambda ab: summed(blocks, (ab, w, folds, high, low), _platt_sums)[0]
    ab = np.stack([np.zeros(high.shape), np.log((low + 1) / (high + 1))], axis=2)
    now, done = sums(ab), np.zeros(high.shape, bool)
    for _ in range(max_iter):
        done |= np.abs(now[1:3]).max(axis=0) < 1e-10 * (high + low)
        if done.all():
            break
        second = np.stack([np.stack([now[3], now[4]], axis=-1), np.stack([now[4], now[5]], axis=-1)], axis=-2) + 1e-12 * np.eye(2)
        first = np.stack([now[1], now[2]], axis=-1)
        step = np.linalg.solve(second, -first[..., None])[..., 0]
        slope, t = (first * step).sum(axis=-1), np.where(done, 0.0, 1.0)
        while True:
            there = sums(ab + t[..., None] * step)
            bad = ~done & (there[0] > now[0] + 1e-4 * t * slope + 1e-13 * np.abs(now[0]))  # rounding aside
            if not bad.any():
                break
            t[bad] /= 2
            late = bad & (t <= 1e-10)
            done |= late
            t[late] = 0
        ab, now = ab + t[..., None] * step, there
    return ab


def fit(features: DataFrame, width: int, folds: int = FOLDS, max_iter: int = 100, key: str = "seq") -> Model:
    """A model of all rows (key, label, indices, values) of ``features``; null labels teach nothing.

    Each class is told from the others by support vectors with the squared hinge loss, its own rows weighing
    n / (classes * n of the class) of the fold's training rows. Folds deal out each class in the order of a
    seeded shuffle of the keys. A class that a fold's training or other rows don't have gets coefficients of 0
    there. Rows without features count by the intercept, rows without a key teach nothing, and no rows give a
    model without classes. Every pass reads the written blocks, so a lost executor costs its tasks only.
    """
    spark = features.sparkSession
    rows = features.where("label is not null").select(key, "label", "indices", "values")
    elements = rows.agg(F.sum(F.coalesce(F.size("indices"), F.lit(0)) + 1)).first()[0] or 0
    n = max(1, -(-elements // TASK_VALUES))
    # the same rows in the same order however they came, so that sums don't depend on that
    table, path = scratch.keep(with_fold(rows, folds, key).repartition(n, key).sortWithinPartitions(key, "label"))
    counts = table.groupBy("label", "fold").agg(F.count("*").alias("n")).collect()  # one row a class and fold
    classes = sorted({r["label"] for r in counts})
    if not classes:
        return Model([], [Fold(np.zeros((0, width)), *(np.zeros(0) for _ in range(3))) for _ in range(folds)])
    held = np.zeros((folds, len(classes)))
    for r in counts:
        held[r["fold"], classes.index(r["label"])] = r["n"]
    inside = held.sum(axis=0) - held
    other = lambda x: x.sum(axis=1, keepdims=True) - x
    solvable = (held > 0) & (other(held) > 0) & (inside > 0) & (other(inside) > 0)
    at = np.argwhere(solvable)
    w = np.zeros((folds, width + 1, len(classes)))
    ab = np.zeros((folds, len(classes), 2))
    if len(at):
        weight = inside.sum(axis=1, keepdims=True) / (len(classes) * np.maximum(inside, 1))
        blocks, blocks_path = scratch.keep(_blocks(table, classes, width))
        solved = support_vectors(blocks, Problems(at[:, 0], at[:, 1], weight[at[:, 0], at[:, 1]]), width, len(classes), max_iter)
        w[at[:, 0], :, at[:, 1]] = solved.T
        ab = np.where(solvable[..., None], platt(blocks, w, held, other(held), max_iter), 0.0)
        scratch.drop(spark, blocks_path)
    scratch.drop(spark, path)
    return Model(classes, [Fold(w[f, :-1].T.copy(), w[f, -1].copy(), ab[f, :, 0].copy(), ab[f, :, 1].copy()) for f in range(folds)])
