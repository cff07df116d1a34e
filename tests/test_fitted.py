import inspect

import numpy as np

from commitloom.operators import features, scoring, training
from commitloom.plans import registry

DATA = "/root/testdata/sf0.001"


def test_assembled_features_use_the_default_sizes(spark):
    rows = registry.QUERIES["assembled_features"](spark, DATA).collect()
    spec = features.fit(registry._numbered(spark, DATA))
    assert max(max(r["indices"]) for r in rows) == spec.width - 1 >= 805  # 500 terms, 200 paths, 100 extensions, 5 more


def test_fitted_scores_fit_all_labels_at_the_default_sizes(spark, monkeypatch):
    asked = []

    def fit(*args, **more):
        had = inspect.signature(real).bind(*args, **more)
        had.apply_defaults()
        asked.append(had.arguments)
        labels = sorted(r.label for r in args[0].select("label").distinct().collect())
        n, zeros = len(labels), np.zeros(len(labels))
        return scoring.Model(labels, [scoring.Fold(np.zeros((n, args[1])), zeros, zeros, zeros)])

    real = training.fit
    monkeypatch.setattr(training, "fit", fit)
    rows = registry.QUERIES["fitted_scores"](spark, DATA).collect()
    want = {r.label for r in registry.labelled(spark, DATA).where("label is not null").select("label").distinct().collect()}
    (had,) = asked
    assert had["max_iter"] == inspect.signature(real).parameters["max_iter"].default == 100
    assert had["width"] == features.fit(registry._numbered(spark, DATA)).width
    assert {r.label for r in had["features"].select("label").distinct().collect()} == want and len(want) > 2
    assert "max_rows" not in had and len(rows) == 3 * len({r["seq"] for r in rows})
