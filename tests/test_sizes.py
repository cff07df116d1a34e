import numpy as np
from pyspark.sql import functions as F

from commitloom.functions import text as T
from commitloom.operators import features, training
from commitloom.operators.scoring import Sparse
from commitloom.streaming import dedup as streams


def test_terms_are_counted_in_the_row(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, None), (4, ["x"])], "k long, t array<string>")
    got = {r.k: r.c and [tuple(x) for x in r.c] for r in df.select("k", T.counted(F.col("t")).alias("c")).collect()}
    assert got == {1: [("a", 1), ("b", 2)], 2: None, 3: None, 4: [("x", 1)]}


def test_tfidf_has_the_same_bits_however_rows_came(spark):
    r = np.random.default_rng(3)
    docs = spark.createDataFrame([(i, [f"w{x}" for x in r.integers(0, 300, 400)]) for i in range(60)], "k long, t array<string>")
    vocab = spark.createDataFrame([(f"w{i}", i, float(v)) for i, v in enumerate(r.random(300))], "term string, idx int, idf double")
    plain = features.tfidf(docs, "k", F.col("t"), vocab)
    again = features.tfidf(docs.withColumn("t", F.reverse("t")).repartition(7), "k", F.col("t"), vocab)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, again.collect()))
    # rows are counted before they are shuffled, and no task holds counts of all its documents
    assert "Aggregate" not in plain._jdf.queryExecution().executedPlan().toString()


def test_a_block_keeps_common_features_dense():
    r = np.random.default_rng(4)
    x = (r.random((300, 50)) < np.r_[np.full(40, 0.3), np.full(10, 0.003)]) * r.random((300, 50))
    x[:, -1] = 1
    at = np.nonzero(x)
    starts = np.r_[0, np.cumsum((x != 0).sum(axis=1))]
    block = training.Block(Sparse(starts, at[1], x[at]), np.zeros(300, np.int32), np.zeros(300, np.int32))
    assert 0 < len(block.at) < 30 and block.dense.shape[1] > 30
    w, total = r.random((50, 4)), np.zeros((50, 4))
    out = r.random((300, 4))
    block.back(out, total)
    assert np.allclose(block.times(w), x @ w, rtol=1e-12) and np.allclose(total, x.T @ out, rtol=1e-12)


def test_tasks_let_few_rows_of_a_label_through(spark):
    rows = spark.createDataFrame([(999 - i, "a" if i % 3 else None, "x" * 50) for i in range(1_000)], "seq long, label string, diff_text string").repartition(2)
    got = streams._at_most(rows, 5, "label").collect()
    assert len(got) <= 2 * 2 * 5
    for label in ("a", None):
        every = sorted(r.seq for r in rows.collect() if r.label == label)
        assert set(every[:5]) <= {r.seq for r in got if r.label == label}
