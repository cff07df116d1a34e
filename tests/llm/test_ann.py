import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from commitloom.llm import ann, queries


def brute(ids, x, chosen, k):
    out = {}
    for q in chosen:
        i = ids.index(q)
        s = [(-float((x[i] * x[j]).sum()), ids[j]) for j in range(len(ids)) if j != i]
        out[q] = [(v, -a) for a, v in sorted(s)[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_turning_keeps_angles():
    x = np.random.default_rng(0).normal(size=(5, 50))
    y = ann.turned(x, ann.rotations(50, 1)[0])
    assert y.shape == (5, 64) and np.allclose(y @ y.T, x @ x.T * 64**3)
    assert (ann.costs(y).argmin(axis=1) == ann.nearest_axis(y)).all()


def test_cheapest_buckets_equal_brute_force():
    rng = np.random.default_rng(1)
    for hashes in (1, 2, 3):
        each = [ann.costs(rng.normal(size=(1, 4)))[0] for _ in range(hashes)]
        total = each[0]
        for c in each[1:]:
            total = (total[:, None] + c).ravel()
        order = np.lexsort((np.arange(len(total)), total))
        assert ann.cheapest(each, np.inf, 5)[0].tolist() == order[:5].tolist()
        most = float(np.sort(total)[len(total) // 3])
        bucket, cost = ann.cheapest(each, most)
        assert bucket.tolist() == order[: len(bucket)].tolist() and len(bucket) == (total <= most).sum() and np.allclose(cost, total[bucket])
    assert [ann.hashes_of(n, 128) for n in (0, 10_000, 64 * 128**2 - 1, 64 * 128**2, 10**9)] == [1, 1, 1, 2, 3]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_against_brute_force(spark, sf):
    t = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").toPandas()
    ids, x = t.vec_id.tolist(), np.stack(t.embedding).astype(float)
    got = found(queries.op2_nearest_neighbours(spark, f"/root/testdata/{sf}"))
    want = brute(ids, x, [i for i in ids if i % 20 == 0], 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 20 for q in want]) >= 0.9
    for q, rows in got.items():
        assert [(-s, v) for v, s in rows] == sorted((-s, v) for v, s in rows)
        assert all(math.isclose(s, float(x[ids.index(q)] @ x[ids.index(v)]), rel_tol=1e-12, abs_tol=1e-12) for v, s in rows)


def test_ties_bad_vectors_and_small_tables(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 16)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(30, 6)).astype(np.float32) * rng.choice([0.01, 1, 300], (30, 1)).astype(np.float32)
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)] + [(100 + i, x[0].tolist(), "copy") for i in range(200)]
    # an id of several rows counts once, with its best
    again = [(1, (-x[1]).tolist(), "again"), (60, x[7].tolist(), "again"), (60, (x[7] / 3).tolist(), "again")]
    bad = [(400, None, ""), (420, [0.0] * 6, ""), (440, [1.0, None, 0.0, 0.0, 0.0, 0.0], ""), (460, [math.nan] + [1.0] * 5, ""), (480, [math.inf] + [1.0] * 5, ""), (500, [1.0], ""), (520, [], ""), (None, x[0].tolist(), "")]
    df = spark.createDataFrame(rows + again + bad + rows[:3], "vec_id long, embedding array<float>, score string")
    rows += again
    got = found(ann.search(df, F.col("vec_id") % 20 == 0, k=20))
    want = {}
    for q in {r[0] for r in rows if r[0] % 20 == 0}:
        best = {}
        for a in rows:
            for b in rows:
                if a[0] == q and b[0] != q:
                    best[b[0]] = max(best.get(b[0], -math.inf), float((np.array(a[1], np.float32).astype(float) * np.array(b[1], np.float32)).sum()))
        want[q] = [(v, n) for n, v in sorted((-n, v) for v, n in best.items())[:20]]
        want[q] = [(v, -n) for v, n in want[q]]
    assert got.keys() == want.keys()
    for q in want:
        assert [v for v, _ in got[q]] == [v for v, _ in want[q]]
    few = found(ann.search(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") == 0))
    assert len(few[0]) == 2
    assert ann.search(df.where("false"), F.col("vec_id") == 0).count() == 0
    assert ann.search(df.where("vec_id >= 400"), F.col("vec_id") == 0).count() == 0


def recall(spark, x, step, **how):
    """Of every step-th vector's 20 nearest, the share that the search finds."""
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = found(ann.search(df, F.col("vec_id") % step == 0, k=20, **how))
    x = x.astype(float)
    share = []
    for q in range(0, len(x), step):
        s = x @ x[q]
        s[q] = -np.inf
        share.append(len(set(np.argsort(-s)[:20].tolist()) & {v for v, _ in got[q]}) / 20)
    return np.mean(share)


@pytest.mark.parametrize("sigma", [0.5, 1.0])
def test_recall_of_mixed_lengths(spark, sigma):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(20_000, 64))
    x *= (rng.lognormal(0, sigma, 20_000) / np.sqrt((x**2).sum(axis=1)))[:, None]
    assert recall(spark, x.astype(np.float32), 200) >= 0.9


@pytest.mark.parametrize("sf, step", [("sf0.01", 20), ("sf0.1", 20)])
def test_recall_of_the_delivered_tables(spark, sf, step):
    t = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").orderBy("vec_id").toPandas()
    assert recall(spark, np.stack(t.embedding), step) >= 0.9


def clustered(n, seed=8):
    """Vectors about n / 50 centres, at a cosine of about 0.9 to each other."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(1, n // 50), 32))
    x = centres[rng.integers(0, len(centres), n)] + 0.33 * rng.normal(size=(n, 32))
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def test_recall_of_several_rotations(spark):
    assert recall(spark, clustered(20_000).astype(np.float32), 200, hashes=2) >= 0.9


def test_buckets_looked_at_and_recall_as_vectors_grow():
    """By the operator's own hashes, costs and reaches: the share of vectors met falls, and recall stays."""
    shares = []
    for n in (2_500, 10_000, 40_000):
        x, k = clustered(n), 20
        size, tables, hashes = 32, ann.TABLES, 2 if n > 10_000 else 1
        signs = ann.rotations(32, tables * hashes).reshape(tables, hashes, 3, size)
        reach = ann.reaches(size, tables, hashes)
        at = np.zeros((n, tables), np.int64)
        for t in range(tables):
            for s in signs[t]:
                at[:, t] = at[:, t] * 2 * size + ann.nearest_axis(ann.turned(x, s))
        hit, met = [], []
        for q in range(0, n, n // 50):
            score = x @ x[q]
            score[q] = -np.inf
            best = np.argsort(-score)[:k]
            most = reach[int(score[best[-1]] * ann.COSINES)]
            seen = np.zeros(n, bool)
            for t in range(tables):
                each = [ann.costs(ann.turned(x[q : q + 1], s) / size)[0] for s in signs[t]]
                seen |= np.isin(at[:, t], np.union1d(ann.cheapest(each, most)[0], ann.cheapest(each, np.inf, ann.PROBES)[0]))
            hit.append(seen[best].mean())
            met.append(seen.mean())
        print(n, hashes, "recall", np.mean(hit), "met", np.mean(met))
        assert np.mean(hit) >= 0.9
        shares.append(np.mean(met))
    assert shares[2] < shares[1] <= 1.2 * shares[0]


def test_recall_of_unit_vectors(spark):
    x = np.random.default_rng(6).normal(size=(20_000, 64))
    x /= np.sqrt((x**2).sum(axis=1, keepdims=True))
    assert recall(spark, x.astype(np.float32), 200) >= 0.9
