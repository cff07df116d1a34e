import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from commitloom import scratch
from commitloom.operators import features, scoring, stages, training
from commitloom.plans import registry

DATA = "/root/testdata/sf0.001"


def test_a_saved_pipeline_is_loaded_as_one(spark, tmp_path):
    rows, _ = scratch.keep(registry._numbered(spark, DATA).withColumn("label", F.when(F.col("seq") % 3 == 0, "fix").when(F.col("seq") % 3 == 1, "feat").when(F.col("seq") % 5 == 0, "")))
    unfitted = Pipeline(stages=[stages.DiffFeatures(maxTerms=60, maxPaths=20, maxExts=5), stages.CalibratedSVC(maxIter=4)])
    unfitted.write().overwrite().save(f"file://{tmp_path}/unfitted")
    unfitted = Pipeline.load(f"file://{tmp_path}/unfitted")
    assert unfitted.getStages()[0].getOrDefault("maxTerms") == 60 and unfitted.getStages()[1].getOrDefault("maxIter") == 4
    fitted = unfitted.fit(rows)
    fitted.write().overwrite().save(f"file://{tmp_path}/fitted")
    loaded = PipelineModel.load(f"file://{tmp_path}/fitted")
    assert [s.uid for s in loaded.stages] == [s.uid for s in fitted.stages] and loaded.stages[0].spec == fitted.stages[0].spec
    for one, other in zip(loaded.stages[1].model.folds, fitted.stages[1].model.folds, strict=True):
        assert all(np.array_equal(getattr(one, k), getattr(other, k)) for k in ("coef", "intercept", "a", "b"))
    # what the functions give
    spec = features.fit(features.inputs(rows), max_terms=60, max_paths=20, max_exts=5)
    assert loaded.stages[0].spec == spec and loaded.stages[1].classes == ["feat", "fix"]
    vectors, _ = scratch.keep(features.transform(features.inputs(rows), spec).join(rows.select("seq", F.nullif("label", F.lit("")).alias("label")), "seq"))
    model = training.fit(vectors, spec.width, max_iter=4)
    want = {r.seq: r.probs for r in scoring.score(vectors, model).collect()}
    got = {r.seq: (r.probs, r.prediction) for r in loaded.transform(rows).collect()}
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k][0], want[k], atol=1e-9) and got[k][1] == model.classes[int(np.argmax(want[k]))] for k in want)


def test_copies_and_parameters(spark):
    rows = registry._numbered(spark, DATA)
    stage = stages.DiffFeatures(stopWords=["the"], maxTerms=3, maxPaths=0, maxExts=0)
    model = stage.fit(rows, {stage.maxTerms: 2})
    assert len(model.spec.terms) == 2 and model.spec.paths == [] and model.getOrDefault("maxTerms") == 2
    out = model.transform(rows)
    assert out.schema["indices"].metadata["width"] == 7 and set(rows.columns) < set(out.columns)
