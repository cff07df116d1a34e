import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from commitloom.llm import lexical, queries

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def brute(docs, items, k=20):
    docs = [(d, Counter(terms(t))) for d, t in docs if d is not None and terms(t)]
    n, length = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, Counter()).update(terms(t))
    out = []
    for i, wanted in asked.items():
        scored = []
        for d, c in docs:
            m = 100 - 25 + 25 * sum(c.values()) * n // length
            s = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, times in wanted.items() if t in c)
            if s > 0:
                scored.append((-s, d))
        out += [(i, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def run(spark, docs, items, **more):
    docs = spark.createDataFrame([(d, t, 0, 0) for d, t in docs], "doc_id long, text string, score int, item_id int").repartition(3)
    items = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    return sorted(map(tuple, lexical.search(docs, items, **more).collect()))


def corpus(seed=3, n=400):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "straße", "x1", "ÀB"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    docs = [(i, r.choice([" ", "-", "\n"]).join(r.choices(vocabulary, weights, k=r.choice([1, 5, 40, 200])))) for i in range(n)]
    items = [(i, " ".join(r.choices(vocabulary, weights, k=r.choice([1, 3, 25])))) for i in range(30)]
    return docs, items


@pytest.mark.parametrize("more", [{}, {"shard": 500}, {"shard": 1, "block_terms": 20}, {"k": 3, "shard": 2_000}])
def test_search_equals_brute_force(spark, more):
    docs, items = corpus()
    docs += [(900, None), (901, ""), (None, "w1 w2"), (902, "!?"), (903, "w0 " * 30_000), (904, "W7 w7"), (905, "w7 W7"), (906, "w7,w7")]
    items += [(50, None), (51, ""), (None, "w1"), (52, "unheard words"), (53, "w5"), (53, "W6 w5"), (54, "w7 " * 500), (55, "w0")]
    got = run(spark, docs, items, **more)
    assert got == brute(docs, items, more.get("k", 20)) and len(got) > 80


def test_ties_go_to_smaller_ids_and_repeated_rows_are_documents(spark):
    docs = [(i, "same words here") for i in range(60)] + [(5, "same words here"), (99, "other")]
    got = run(spark, docs, [(1, "same")], shard=7)
    assert [g[2] for g in got] == [0, 1, 2, 3, 4, 5, 5, *range(6, 19)] and got == brute(docs, [(1, "same")])


def test_empty_tables(spark):
    docs, items = corpus(n=5)
    assert run(spark, [], items) == [] and run(spark, docs, []) == [] and run(spark, [(1, None), (2, " ")], items) == []


def test_lists_that_are_not_essential_are_only_probed():
    r = np.random.default_rng(1)
    at, doc, gives = [], [], []
    for term, df in enumerate([5, 40, 5_000, 9_000, 10_000]):
        d = r.choice(10_000, df, replace=False)
        at += [term] * df
        doc += d.tolist()
        gives += r.integers(1, 1000, df).tolist()
    lists = lexical.Lists(np.array(at), np.array(doc), np.array(gives), 5)
    weights = np.array([5_000, 3_000, 20, 3, 1])
    found, score, read = lexical.best(lists, 10_000, np.arange(5), weights, 5, 1)
    total = np.bincount(doc, np.array(gives) * weights[at], 10_000).astype(np.int64)
    least = np.sort(total)[-5]
    assert set(np.flatnonzero(total >= least)) <= set(found.tolist()) and (score == total[found]).all()
    assert read < 5 + 40 + 5_000 + 200  # of 24,045 postings


def test_query_equals_brute_force(spark):
    data = "/root/testdata/sf0.001"
    got = queries.op13_lexical_search(spark, data)
    assert got.columns[:4] == ["item_id", "rank", "doc_id", "score"]
    table = lambda name, key: [(r[key], r["text"]) for r in spark.read.parquet(f"{data}/{name}.parquet").collect()]
    assert sorted(map(tuple, got.collect())) == brute(table("documents", "doc_id"), table("benchmark", "item_id"))
