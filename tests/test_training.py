import numpy as np

from commitloom import scratch
from commitloom.operators import features, scoring, training
from commitloom.plans import registry
from tests import plain_training


def dense(x):
    sizes = np.count_nonzero(x, axis=1)
    return scoring.Sparse(np.r_[0, np.cumsum(sizes)], np.nonzero(x)[1], x[np.nonzero(x)])


def test_squared_hinge_is_at_its_minimum():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 6)) * (rng.random((80, 6)) < 0.5)
    y = np.where(x[:, 0] + 0.5 * rng.normal(size=80) > 0, 1.0, -1.0)
    cost = np.where(y > 0, 1.7, 1.0)
    w = plain_training.squared_hinge(dense(x), y, cost, 6)
    full = np.c_[x, np.ones(80)]
    value = lambda v: 0.5 * v @ v + cost @ np.maximum(0, 1 - y * (full @ v)) ** 2
    gradient = w - 2 * full.T @ (cost * y * np.maximum(0, 1 - y * (full @ w)))
    assert np.abs(gradient).max() < 1e-5
    assert all(value(w) <= value(w + 1e-3 * rng.normal(size=7)) for _ in range(200))


def test_platt_is_at_its_minimum():
    rng = np.random.default_rng(3)
    margin = rng.normal(size=200)
    mine = margin + rng.normal(size=200) > 0.5
    a, b = plain_training.platt(margin, mine)
    high, low = mine.sum(), (~mine).sum()
    target = np.where(mine, (high + 1) / (high + 2), 1 / (low + 2))
    p = lambda a, b: 1 / (1 + np.exp(a * margin + b))
    loss = lambda a, b: -(target * np.log(p(a, b)) + (1 - target) * np.log(1 - p(a, b))).sum()
    assert a < 0 and all(loss(a, b) <= loss(a + da, b + db) for da in (-1e-3, 0, 1e-3) for db in (-1e-3, 0, 1e-3))


def test_fit_tells_classes_apart(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(240):
        c = i % 3
        rows.append((i, "abc"[c], [c, 3, 4], [1.0, float(rng.normal()), 1.0]))
    rows += [(900, "rare", [0], [1.0]), (901, None, [1], [1.0])]
    df = spark.createDataFrame(rows, "seq long, label string, indices array<int>, values array<double>")
    model = training.fit(df, 5)
    assert model.classes == ["a", "b", "c", "rare"] and len(model.folds) == 3
    assert all((f.coef[3] == 0).all() for f in model.folds)
    again = training.fit(df.repartition(7), 5)
    assert all((f.coef == g.coef).all() for f, g in zip(model.folds, again.folds, strict=True))
    probs = scoring.score(df, model)
    got = {r.seq: r.label for r in scoring.predict(probs, model.classes).collect()}
    assert all(got[i] == "abc"[i % 3] for i in range(240))
    # the forward pass, row by row
    for r in probs.join(df, "seq").limit(20).collect():
        want = np.zeros(4)
        for f in model.folds:
            m = np.array([sum(f.coef[c][i] * v for i, v in zip(r["indices"], r["values"], strict=True)) + f.intercept[c] for c in range(4)])
            p = 1 / (1 + np.exp(f.a * m + f.b))
            want += p / p.sum() / 3
        assert np.allclose(r["probs"], want, atol=1e-12)
    empty = training.fit(df.where("label = 'none'"), 5)
    assert empty.classes == [] and scoring.score(df, empty).first()["probs"] == []


def held_against_plain(model, rows, folds=3):
    """Whether a model's coefficients and sigmoids are those of the plain solvers, given rows (label, fold, indices, values)."""
    width = model.folds[0].coef.shape[1]
    starts = np.r_[0, np.cumsum([len(r["indices"]) for r in rows])].astype(np.int64)
    x = scoring.Sparse(starts, np.concatenate([r["indices"] for r in rows]).astype(np.int64), np.concatenate([r["values"] for r in rows]).astype(float))
    label = np.array([model.classes.index(r["label"]) for r in rows])
    fold = np.array([r["fold"] for r in rows])
    solved = 0
    for f in range(folds):
        for c in range(len(model.classes)):
            coef, rest = plain_training.one_against_rest(x, label, fold != f, c, len(model.classes), width, 100)
            got = model.folds[f]
            assert np.abs(got.coef[c] - coef).max() < 1e-6
            assert np.allclose([got.intercept[c], got.a[c], got.b[c]], rest, rtol=1e-5, atol=1e-6)
            solved += rest != [0.0] * 3
    return solved


def test_fit_equals_plain_solvers_on_small_rows(spark, monkeypatch):
    monkeypatch.setattr(training, "BLOCK_VALUES", 20)
    rng = np.random.default_rng(7)
    rows = []
    for i in range(150):
        some = sorted(rng.choice(12, rng.integers(0, 6), replace=False).tolist())
        rows.append((i, rng.choice(["a", "b", "c"], p=[0.6, 0.3, 0.1]), some, rng.normal(size=len(some)).tolist()))
    rows += [(200, "once", [1], [1.0]), (201, None, [1], [9.0]), (3, rows[3][1], [2], [0.5]), (202, "a", None, None)]
    df = spark.createDataFrame(rows, "seq long, label string, indices array<int>, values array<double>")
    model = training.fit(df, 12)
    dealt = training.with_fold(df.where("label is not null")).collect()
    assert len(dealt) == len(rows) - 1 and len({r["fold"] for r in dealt if r["seq"] == 3}) == 1
    plain = [{"label": r["label"], "fold": r["fold"], "indices": r["indices"] or [], "values": r["values"] or []} for r in dealt]
    assert held_against_plain(model, plain) == 9 and (model.folds[0].coef[3] == 0).all()


def test_fit_of_the_delivered_documents_equals_plain_solvers(spark):
    rows, _ = scratch.keep(registry._numbered(spark, "/root/testdata/sf0.01"))
    spec = features.fit(rows, max_terms=300, max_paths=50)
    vectors, _ = scratch.keep(features.transform(rows, spec).join(rows.select("seq", "label"), "seq"))
    model = training.fit(vectors, spec.width)
    assert held_against_plain(model, training.with_fold(vectors).collect()) == 33


def test_features_that_go_together_take_few_passes(spark, monkeypatch):
    """Counts passes over the rows on features of unlike lengths that depend on each other, some of them outside the inverted part."""
    monkeypatch.setattr(training, "NEAR_BYTES", 4 * 3 * 24**2)
    passes, real = [], training.summed

    def summed(*args, **more):
        passes.append(args[2].__name__)
        return real(*args, **more)

    monkeypatch.setattr(training, "summed", summed)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 30)) @ np.diag(np.geomspace(0.1, 4, 30)) @ np.linalg.qr(rng.normal(size=(30, 30)))[0]
    y = np.argmax(x @ rng.normal(size=(30, 3)) + 5 * rng.normal(size=(600, 3)), axis=1)
    df = spark.createDataFrame([(i, "abc"[c], list(range(30)), v.tolist()) for i, (c, v) in enumerate(zip(y, x, strict=True))], "seq long, label string, indices array<int>, values array<double>")
    model = training.fit(df, 30)
    assert held_against_plain(model, training.with_fold(df).collect()) == 9
    assert passes.count("_bent") < 150


def test_folds_deal_out_each_label_evenly(spark):
    df = spark.range(1000).selectExpr("id AS seq", "CASE WHEN id % 10 = 0 THEN 'x' ELSE 'y' END AS label")
    sizes = {(r.label, r.fold): r["count"] for r in training.with_fold(df).groupBy("label", "fold").count().collect()}
    assert sorted(sizes.values()) == [33, 33, 34, 300, 300, 300]
