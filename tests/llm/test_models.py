import itertools
import random
import tracemalloc
import zlib

import numpy as np
import pytest

from commitloom.llm import langid, queries, toxicity, wordgrams

DATA = "/root/testdata/sf0.01"


def enumerated(scores, transitions):
    """Marginals of one sequence over all labellings."""
    t, k = scores.shape
    out, total = np.zeros((t, k)), 0.0
    for path in itertools.product(range(k), repeat=t):
        p = np.exp(sum(scores[i, y] for i, y in enumerate(path)) + sum(transitions[a, b] for a, b in zip(path, path[1:])))
        p *= np.exp(transitions[:, path[0]]).sum() / k
        total += p
        for i, y in enumerate(path):
            out[i, y] += p
    return out / total


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    scores, transitions = rng.normal(size=(2, 6, 3)), rng.normal(size=(3, 3))
    gamma, pairs = langid.forward_backward(scores, transitions)
    for i in range(2):
        assert np.allclose(gamma[i], enumerated(scores[i], transitions))
    assert np.isclose(pairs.sum(), 12)


def test_stretches_equal_one_walk():
    rng = np.random.default_rng(1)
    u, transitions = np.exp(rng.normal(size=(50, 4))), rng.normal(size=(4, 4))
    sizes = np.array([1, 31, 32, 33, 64, 65, 500, 2])
    word = rng.integers(0, 50, sizes.sum())
    got = langid.mean_marginals(u, transitions, word, sizes)
    at = 0
    for n, g in zip(sizes, got):
        gamma, _ = langid.forward_backward(np.log(u[word[at : at + n]])[None], transitions)
        assert np.allclose(g, gamma[0].mean(axis=0))
        at += n


def test_words_of_equal_spelling_have_equal_sums():
    weights = np.random.default_rng(2).normal(size=(2**10, 2))
    a = wordgrams.sums(["alpha", "b", "gamma"], weights, (2, 3))
    b = wordgrams.sums(["gamma", "x" * 300, "alpha"], weights, (2, 3))
    assert np.allclose(a[0], b[2]) and np.allclose(a[2], b[0]) and wordgrams.sums([], weights, (2, 3)).shape == (0, 2)


def test_language_id_held_out(spark):
    rows = queries.op4_language_id(spark, DATA).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang").collect()}
    assert len(rows) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held)


def test_code_switched_words():
    rng = random.Random(4)
    make = {"aa": "bcdfa", "bb": "lmnoe"}
    word = lambda y: "".join(rng.choices(make[y], k=5))
    model = langid.train([(" ".join(word(y) for _ in range(80)), y) for y in make for _ in range(60)])
    text = " ".join([word("aa") for _ in range(60)] + [word("bb") for _ in range(40)])
    (lang,), (score,) = langid.Predictor(model)([text])
    assert lang == "aa" and abs(score - 0.6) < 0.05
    assert model.transitions[0, 0] > model.transitions[0, 1]


def test_language_id_cases(spark):
    model = langid.train([("the cat and dog", "en"), ("le chat et chien", "fr")] * 20)
    rows = [(1, None, "x", "y"), (2, "", None, "z"), (3, "123 !!", None, None), (4, "the cat " * 20000, None, None), (4, "le chat", None, None), (None, "dog", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string, other string")
    got = langid.identify(df, model).collect()
    assert sorted((str(r.doc_id), r.lang_pred) for r in got) == [("1", "und"), ("2", "und"), ("3", "und"), ("4", "en"), ("4", "fr"), ("None", "en")]
    assert langid.identify(df.where("false"), model).count() == 0
    assert {r.lang_pred for r in langid.identify(df, langid.train([])).collect()} == {"und"}


def test_toxicity_held_out(spark):
    rows = queries.op9_toxicity(spark, DATA).collect()
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    pairs = [(a.score, b.score) for a in rows if a.held_out and label.get(a.doc_id) == 1 for b in rows if b.held_out and label.get(b.doc_id) == 0]
    assert np.mean([a > b for a, b in pairs]) >= 0.97


def test_toxicity_cases(spark):
    model = toxicity.train([("you idiot fool", 1), ("a nice day here", 0)] * 30)
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "idiot " * 50000, None), (3, "nice day", None)], "doc_id long, text string, score string")
    got = {(r.doc_id, r.text and r.text[:4]): r.score for r in toxicity.score(df, model).collect()}
    assert got[1, None] == got[2, ""] and got[3, "idio"] > 0.5 > got[3, "nice"]
    assert toxicity.score(df.where("false"), model).count() == 0
    for samples in ([], [("a", 1)], [("a", 0), ("b", 0)], [("", 1), ("1", 0)]):
        assert 0 < toxicity.Scorer(toxicity.train(samples))(["a b"])[0] < 1


@pytest.mark.parametrize("salt", [0, 1])
def test_equal_texts_have_equal_scores(salt):
    model = toxicity.train([("you idiot fool", 1), ("a nice day here", 0)] * 30)
    warm = toxicity.Scorer(model)
    warm(["fool nice zebra", "here there"] * (salt + 1))
    assert warm(["nice fool here idiot"]) == toxicity.Scorer(model)(["nice fool here idiot"])


def test_toxicity_training_holds_few_bytes_a_feature():
    r = random.Random(5)
    words = ["".join(r.choices("abcdefghijklmnopqrst", k=9)) for _ in range(120_000)]
    samples = [(" ".join(words[i::400]), i % 2) for i in range(400)]
    features = len(wordgrams.hashed(words[:1_000], toxicity.SIZES, toxicity.BITS)[0]) * 120
    tracemalloc.start()
    toxicity.train(samples)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * features


def test_toxicity_learns_from_ends_of_long_texts(spark):
    rows = [(i, "a nice day here " * 500 + ("you idiot fool" if i % 2 else "with some friends")) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "int(doc_id % 2) as toxic")
    bad, good = toxicity.Scorer(toxicity.fit(docs, labels))(["idiot fool", "some friends"])
    assert bad > 0.5 > good


def test_language_id_learns_from_whole_texts(spark):
    start = "the cat and dog " * 300
    rows = [(i, start + ("le chat et chien " if i % 2 else "el gato y perro ") * 3_000, "fr" if i % 2 else "es") for i in range(60)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert langid.Predictor(model)(["le chat et chien", "el gato y perro"])[0] == ["fr", "es"]
    assert all(s > 0.8 for s in langid.Predictor(model)(["le chat et chien", "el gato y perro"])[1])


def test_spans_cover_every_word():
    for n in (0, 1, 7, 30, 31, 59, 60, 61, 1_000):
        spans = langid.spans_of(np.arange(n))
        assert set(spans.ravel()) == set(range(n)) and len(spans) == -(-n // langid.SPAN)


def test_language_id_learns_from_one_place_of_long_texts(spark):
    r = random.Random(9)
    filler = lambda n: ["".join(r.choices("pqrstuvwxyz", k=6)) for _ in range(n)]
    rows = []
    for i in range(40):
        words, at = filler(3_000), r.randrange(2_900)
        words[at : at + 60] = ("le chat et chien" if i % 2 else "el gato y perro").split() * 15
        rows.append((i, " ".join(words), "fr" if i % 2 else "es"))
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert langid.Predictor(model)(["le chat et chien", "el gato y perro"])[0] == ["fr", "es"]


def test_equal_means_go_to_the_first_language():
    model = langid.Model(["aa", "bb"], np.zeros((2**4, 2)), np.zeros((2, 2)), [set(), set()], np.zeros((2, 2)))
    assert langid.Predictor(model)(["any words"]) == (["aa"], [0.5])


def test_language_id_query_equals_a_plain_version(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    taught = sorted((r.doc_id, r.text, r.lang) for r in docs if r.text is not None and r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2)
    assert len(taught) <= langid.TRAIN_DOCS
    model = langid.train([(x, y) for _, x, y in taught])
    got = {r.doc_id: r for r in queries.op4_language_id(spark, DATA).collect()}
    assert len(got) == len(docs)
    for r in docs:
        words = wordgrams.words_of(r.text or "")
        if not words:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        mean = langid.forward_backward(model.emissions(words)[None], model.transitions)[0][0].mean(axis=0)
        assert got[r.doc_id].lang_pred == model.langs[mean.argmax()] and abs(got[r.doc_id].score - mean.max()) < 1e-6


def test_toxicity_query_equals_a_plain_version(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    taught = sorted((r.doc_id, " ".join(sorted(set(wordgrams.words_of(r.text)))), label[r.doc_id]) for r in docs if r.text is not None and r.doc_id in label)
    model = toxicity.train([(x, y) for _, x, y in taught])
    got = {r.doc_id: r for r in queries.op9_toxicity(spark, DATA).collect()}
    weight = {}
    for r in docs:
        z = model.bias
        for w in set(wordgrams.words_of(r.text or "")):
            if w not in weight:
                _, features = wordgrams.hashed([w], toxicity.SIZES, toxicity.BITS)
                weight[w] = sum(float(model.weights[f, 0]) for f in features)
            z += weight[w]
        assert abs(got[r.doc_id].score - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-6


def test_samples_do_not_depend_on_the_order_of_rows(spark):
    from commitloom.llm import common

    rows = [(i % 7, f"text {i}") for i in range(40)] + [(3, None), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, two = (sorted(map(tuple, common.sample(d, 5).collect())) for d in (df, df.orderBy(df.text.desc()).repartition(5)))
    assert one == two and len(one) == 5 == len({i for i, _ in one})
