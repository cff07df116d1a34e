"""Approximate nearest neighbours by cross-polytope hashing.

Unit vectors are turned by fast pseudo-random rotations (signs and Hadamard transforms, three times) and
assigned to the nearest signed axis. A table's bucket is the axes of one or several rotations: the more
vectors there are, the more rotations, so buckets stay small. A query looks at the buckets in each table
whose axes are nearest to it and ranks what lies there exactly. Large buckets are cut into blocks of bounded
size and each block meets its queries in one matrix product, so a bucket that holds a third of all vectors is
many blocks.

Axes know directions only, so a second look follows: the k-th score that a query has found says what cosine a
vector of each class of lengths needs to be among the k nearest, and the query looks at as many more buckets
for that class as meet such a cosine with a chance of REACH. Long vectors at wide angles are met that way too,
and the nearer a query's neighbours are, the fewer buckets it looks at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from commitloom import scratch
from commitloom.llm import common

#: Tables; buckets that a query looks at in each at first.
TABLES, PROBES = 8, 3
#: Vectors that a bucket holds on the mean, at least: a rotation is added where that leaves so many.
BUCKET = 64
#: The chance, at least, with which the second look meets a vector that is among the k nearest; cosines it tells apart.
REACH, COSINES = 0.95, 64
#: Vectors of a bucket that one block holds, about.
BLOCK = 4_096
#: Scores of this much less than the last that is kept are computed again in the order of the dimensions.
SLACK = 1e-9


def rotations(dimensions: int, tables: int, seed: int = 11) -> np.ndarray:
    """(tables, 3, size) signs of the pseudo-rotations; size is the power of two that holds the dimensions."""
    size = 1 << max(0, dimensions - 1).bit_length()
    return np.random.default_rng(seed).choice(np.array([-1.0, 1.0]), (tables, 3, size))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row, by halves."""
    n, size = x.shape
    step = 1
    while step < size:
        y = x.reshape(n, size // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, size)
        step *= 2
    return x


def turned(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), signs.shape[1]))
    out[:, : x.shape[1]] = x
    for s in signs:
        out = hadamard(out * s)
    return out


def nearest_axis(y: np.ndarray) -> np.ndarray:
    """2 * axis, and 1 more for its positive side."""
    axis = np.abs(y).argmax(axis=1)
    return 2 * axis + (y[np.arange(len(y)), axis] > 0)


def hashes_of(n: int, axes: int) -> int:
    """Rotations of a table of n vectors: as many as leave BUCKET vectors to a bucket, one at least."""
    hashes = 1
    while n >= BUCKET * axes ** (hashes + 1):
        hashes += 1
    return hashes


def costs(y: np.ndarray) -> np.ndarray:
    """Of each row turned by one rotation, how far each signed axis is behind the nearest one, squared."""
    signed = np.empty((len(y), 2 * y.shape[1]))
    signed[:, 0::2], signed[:, 1::2] = -y, y
    return (signed.max(axis=1, keepdims=True) - signed) ** 2


def cheapest(each: list[np.ndarray], most: float, count: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, costs), cheapest first, of one query in one table: those whose axes cost at most so much together; or the first ``count``.

    ``each``: the costs of the axes of each rotation.
    """
    bucket, cost = np.zeros(1, np.int64), np.zeros(1)
    for c in each:
        near = np.flatnonzero(c <= most) if count is None else np.argsort(c, kind="stable")[:count]
        bucket, cost = (bucket[:, None] * len(c) + near).ravel(), (cost[:, None] + c[near]).ravel()
        keep = np.flatnonzero(cost <= most) if count is None else np.lexsort((bucket, cost))[:count]
        bucket, cost = bucket[keep], cost[keep]
    order = np.lexsort((bucket, cost))
    return bucket[order], cost[order]


def reaches(size: int, tables: int, hashes: int = 1, chance: float = REACH, seed: int = 12) -> np.ndarray:
    """For cosines 0, 1 / COSINES, .. 1: the cost of buckets to look at in each table to meet a vector at that cosine with this chance.

    Rotations make it depend on the cosine only, so it is counted over random pairs: what the axes of one cost
    the other. Costs are those of vectors as long as the square root of their size.
    """
    rng = np.random.default_rng(seed)
    pairs = max(200, min(4_000, 2**21 // size // hashes))
    one = 1 - (1 - chance) ** (1 / tables)
    q, v = rng.normal(size=(2, pairs * hashes, size))
    q *= np.sqrt(size) / np.sqrt((q**2).sum(axis=1, keepdims=True))
    v -= (q * v).sum(axis=1, keepdims=True) * q / size
    v *= np.sqrt(size) / np.maximum(np.sqrt((v**2).sum(axis=1, keepdims=True)), 1e-300)
    nearest = np.abs(q).max(axis=1)
    out = np.empty(COSINES + 1)
    for i in range(COSINES + 1):
        c = i / COSINES
        x = c * q + np.sqrt(1 - c * c) * v
        axis = np.abs(x).argmax(axis=1)
        mine = q[np.arange(len(q)), axis] * np.sign(x[np.arange(len(q)), axis])
        cost = ((nearest - mine) ** 2).reshape(pairs, hashes).sum(axis=1)
        out[i] = np.sort(cost)[min(pairs - 1, int(np.ceil(one * pairs)))] + 1e-9
    return np.maximum.accumulate(out[::-1])[::-1]


def matrix(column: pa.Array, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, which rows take part): null, zero and wrongly long ones, and ones with null or non-finite components, don't."""
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    right = lengths == dimensions
    out = np.zeros((len(column), dimensions))
    out[right] = column.filter(pa.array(right)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dimensions)
    return out, right & np.isfinite(out).all(axis=1) & (out != 0).any(axis=1)


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to smaller ids."""
    return np.lexsort((ids, -scores))[:k]


def lengths(x: np.ndarray) -> np.ndarray:
    """Of each row, also where squares would overflow."""
    most = np.abs(x).max(axis=1, initial=1e-300, keepdims=True)
    return np.sqrt(((x / most) ** 2).sum(axis=1)) * most[:, 0]


def hash_vectors(vectors: DataFrame, dimensions: int, signs: np.ndarray, element: str) -> DataFrame:
    """vec_id, embedding, norm (a power of two, rounded), length, bucket (one for each table) of the vectors that take part.

    ``signs``: of each table, of each of its rotations.
    """

    def run(batches):
        for batch in batches:
            x, ok = matrix(batch.column("embedding"), dimensions)
            x, batch = x[ok], batch.filter(pa.array(ok))
            length = lengths(x)
            unit = x / length[:, None]
            bucket = np.zeros((len(x), len(signs)), np.int64)
            for t, rotations_of in enumerate(signs):
                for s in rotations_of:
                    bucket[:, t] = bucket[:, t] * 2 * s.shape[1] + nearest_axis(turned(unit, s))
            norm = np.round(np.log2(length)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), pa.array(norm), pa.array(length), pa.array(list(bucket), pa.list_(pa.int64()))], names=["vec_id", "embedding", "norm", "length", "bucket"])

    return vectors.mapInArrow(run, f"vec_id long, embedding array<{element}>, norm int, length double, bucket array<long>")


def search(vectors: DataFrame, is_query, k: int = 20, tables: int = TABLES, probes: int = PROBES, hashes: int | None = None, second: bool = True) -> DataFrame:
    """query_id, rank, vec_id, score: the k found with the largest inner product with each query.

    ``vectors`` needs vec_id and embedding; other columns are ignored. ``is_query`` is a condition on vec_id.
    Rows of a query's own id are no candidates of it. Rows of equal vec_id are candidates (or queries) of
    their own, and the id counts once with the best score of its rows. Vectors that are null, zero, of another
    length than the most common, or that hold null or non-finite components take no part. Nearest first, ties
    to the smaller vec_id; an empty table gives no rows. A table's buckets are the axes of ``hashes``
    rotations (None: as many as the number of vectors asks for). Vectors of very different lengths are hashed
    by direction and kept apart by length. After a first look of ``probes`` buckets a table at all lengths,
    every query looks at more buckets for those lengths at which vectors of a wider angle can still be among
    the k nearest. Only a query that has found fewer than k, so that any vector counts, looks at all buckets of
    one table. ``second=False`` leaves that out, to measure what the first look finds.
    """
    spark = vectors.sparkSession
    element = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"
    data = vectors.select("vec_id", F.col("embedding").cast(f"array<{element}>").alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    common_size = data.groupBy(F.size("embedding").alias("n")).count().where("n > 0").orderBy(F.desc("count"), "n").first()
    out = "query_id long, rank int, vec_id long, score double"
    if common_size is None:
        return spark.createDataFrame([], out)
    dimensions = common_size["n"]
    size = 1 << max(0, dimensions - 1).bit_length()
    hashes = hashes or hashes_of(common_size["count"], 2 * size)
    signs = rotations(dimensions, tables * hashes).reshape(tables, hashes, 3, size)
    hashed, _ = scratch.keep(hash_vectors(data, dimensions, signs, element))
    places = hashed.select("vec_id", "embedding", "norm", F.posexplode("bucket").alias("t", "b"))
    longest = {r.norm: r.length for r in hashed.groupBy("norm").agg(F.max("length").alias("length")).collect()}
    if not longest:
        return spark.createDataFrame([], out)
    # buckets of several blocks, and how many: joined, as they grow with the vectors
    large, _ = scratch.keep(
        hashed.select("norm", F.posexplode("bucket").alias("t", "b")).groupBy("t", "b", "norm").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("t", "b", "norm", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    )
    every = (2 * size) ** hashes
    # turned vectors of length 1 are longer by this than those that the costs are counted for
    scale = np.sqrt(size) / size**1.5
    reach = reaches(size, tables, hashes)

    def cells(batch, row, key):
        """The batch's rows beside the buckets that they look at."""
        for at in range(0, len(row), 20_000):
            part = batch.take(pa.array(row[at : at + 20_000]))
            t, b, norm = zip(*key[at : at + 20_000], strict=True)
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("embedding"), pa.array(t, pa.int32()), pa.array(b, pa.int64()), pa.array(norm, pa.int32())], names=["vec_id", "embedding", "t", "b", "norm"])

    def looked(batch):
        """(lengths, and of each table the costs of the axes of each of its rotations) of a batch of queries."""
        x, _ = matrix(batch.column("embedding"), dimensions)
        length = lengths(x)
        unit = x / length[:, None]
        return length, [[costs(turned(unit, s) * scale) for s in table] for table in signs]

    def first_look(batches):
        for batch in batches:
            row, key = [], []
            for t, each in enumerate(looked(batch)[1]):
                for i in range(len(batch)):
                    for b in cheapest([c[i] for c in each], np.inf, probes)[0].tolist():
                        for norm in longest:
                            row.append(i)
                            key.append((t, b, norm))
            yield from cells(batch, row, key)

    def second_look(batches):
        for batch in batches:
            length, tables_of = looked(batch)
            row, key = [], []
            least = batch.column("least").to_numpy(zero_copy_only=False).astype(float)
            for i in range(len(batch)):
                most = {}
                for norm, there in longest.items():
                    # null: fewer than k were found, so any vector counts; rounding must not lose one at the bound
                    cosine = least[i] / length[i] / there * (1 - 1e-9) if least[i] > 0 else 0.0
                    if cosine <= 1:
                        most[norm] = reach[int(cosine * COSINES)] if cosine > 0 else np.inf
                finite = [m for m in most.values() if m < np.inf]
                found = [cheapest([c[i] for c in each], max(finite)) if finite else (np.empty(0, np.int64), np.empty(0)) for each in tables_of]
                whole = {norm for norm, m in most.items() if m == np.inf}
                for t, (buckets, cost) in enumerate(found):
                    for norm, m in most.items():
                        if norm in whole:
                            chosen = np.setdiff1d(np.arange(every), cheapest([c[i] for c in tables_of[0]], np.inf, probes)[0]).tolist() if t == 0 else []
                        else:
                            # the first so many have been looked at
                            chosen = buckets[probes : np.searchsorted(cost, m, "right")].tolist()
                        row += [i] * len(chosen)
                        key += [(t, b, norm) for b in chosen]
            yield from cells(batch, row, key)

    queries = hashed.where(is_query).select("vec_id", "embedding")
    base = places.join(large, ["t", "b", "norm"], "left").withColumn("block", F.pmod(F.xxhash64("vec_id", "embedding"), F.coalesce("blocks", F.lit(1)).cast("long")).cast("int"))
    key = ["t", "b", "norm", "block"]

    def near(qx, qi, cx, ci):
        """(query ids, candidate ids, scores) of one block."""
        found = [], [], []
        if not len(qi) or not len(ci):
            return found
        rough = qx @ cx.T
        repeated = len(np.unique(ci)) < len(ci)
        rough[qi[:, None] == ci[None, :]] = -np.inf
        for i, r in enumerate(rough):
            if repeated:  # an id counts once, with its best row
                order = np.lexsort((-r, ci))
                r = r.copy()
                r[order[1:][ci[order][1:] == ci[order][:-1]]] = -np.inf
            least = np.partition(r, len(r) - k)[len(r) - k] if len(r) > k else -np.inf
            some = np.flatnonzero((r >= least - SLACK * max(1.0, abs(least) if np.isfinite(least) else 1.0)) & (r > -np.inf))
            if len(some) > 4 * k:  # of copies of one vector only the smallest ids can be kept
                _, kind = np.unique(cx[some], axis=0, return_inverse=True)
                order = np.lexsort((ci[some], kind.ravel()))
                group = kind.ravel()[order]
                rank = np.arange(len(order)) - np.searchsorted(group, group)
                some = some[order[rank < k]]
            exact = (cx[some] * qx[i]).sum(axis=1)
            best = some[b := top(exact, ci[some], k)]
            found[0].extend([qi[i]] * len(best))
            found[1].extend(ci[best])
            found[2].extend(exact[b])
        return found

    def rerank(batches):
        now, sides = None, [[], []]

        def flush():
            if now is None:
                return
            (qi, qx), (ci, cx) = ((np.concatenate([p[0] for p in side]) if side else np.empty(0, np.int64), np.concatenate([p[1] for p in side]) if side else np.empty((0, dimensions))) for side in sides)
            for at in range(0, len(qi), 1024):
                found = near(qx[at : at + 1024], qi[at : at + 1024], cx, ci)
                yield common.record([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())], *found)

        for batch in batches:
            if not len(batch):
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in key], axis=1)
            side, ids = batch.column("side").to_numpy(), batch.column("vec_id").to_numpy()
            x, _ = matrix(batch.column("embedding"), dimensions)
            cuts = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if (name := tuple(keys[a])) != now:
                    yield from flush()
                    now, sides = name, [[], []]
                for s in (0, 1):
                    mine = np.flatnonzero(side[a:b] == s) + a
                    sides[s].append((ids[mine], x[mine]))
        yield from flush()

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

    def candidates(asked: DataFrame, look) -> DataFrame:
        """query_id, vec_id, score of what lies in the blocks that ``look`` chooses."""
        asked = asked.mapInArrow(look, f"vec_id long, embedding array<{element}>, t int, b long, norm int").join(large, ["t", "b", "norm"], "left")
        asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)).cast("int") - 1)))
        both = asked.withColumn("side", F.lit(0)).select(*key, "side", "vec_id", "embedding").union(base.withColumn("side", F.lit(1)).select(*key, "side", "vec_id", "embedding"))
        dealt = both.repartition(n, *key).sortWithinPartitions(*key)
        return dealt.mapInArrow(rerank, "query_id long, vec_id long, score double")

    def best(found: DataFrame) -> DataFrame:
        kept = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    first, _ = scratch.keep(best(candidates(queries, first_look)))
    if not second:
        return first
    least = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
    more = candidates(queries.join(least, "vec_id", "left").select("vec_id", "embedding", "least"), second_look)
    return best(first.select("query_id", "vec_id", "score").union(more))
