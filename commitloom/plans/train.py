"""The whole training run: split, fit, evaluate, and save."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitloom import scratch
from commitloom.operators import evaluation, features, scoring, stages, training
from commitloom.sources import payload, records


@dataclass
class Trained:
    spec: features.Spec
    model: scoring.Model
    report: DataFrame
    confusion: DataFrame
    check: DataFrame


def train(rows: DataFrame, out: str, share: float = 0.1, seed: int = 42, key: str = "seq", **sizes) -> Trained:
    """Fit a model of commit rows (key, label, diff_text, counts of files and lines) and save it under ``out``.

    ``share`` of each label, by hashes of seed and key, is held out and gives the report and the confusion
    matrix. ``out`` gets the fitted stages (pipeline), the payload (model) and the sorted labels (labels.txt); ``check`` holds the saved
    model's scores of the held-out rows against the fitted one's. Rows without a label are left out.
    ``sizes`` are those of ``features.fit``.
    """
    spark = rows.sparkSession
    labelled = rows.where(F.coalesce("label", F.lit("")) != "")
    split, _ = scratch.keep(features.inputs(evaluation.stratified_split(labelled, share, seed, key=key)))
    taught = split.where(~F.col("is_test"))
    spec = features.fit(taught, **sizes)
    vectors, _ = scratch.keep(features.transform(split, spec, key).join(split.select(key, "label", "is_test"), key))
    model = training.fit(vectors.where(~F.col("is_test")), spec.width, key=key)
    held = vectors.where("is_test")
    probs, _ = scratch.keep(scoring.score(held, model, key))
    pairs = held.select(key, F.col("label").alias("y")).join(scoring.predict(probs, model.classes, key).withColumnRenamed("label", "pred"), key).select("y", "pred")
    fitted = PipelineModel([stages.DiffFeaturesModel(spec).setParams(keyCol=key), stages.CalibratedSVCModel(model).setParams(keyCol=key)])
    fitted.write().overwrite().save(f"{out}/pipeline")
    payload.write_payload(spark, payload.export_payload(spec, model), f"{out}/model")
    records.write_labels(labelled, f"{out}/labels.txt")
    _, saved = payload.import_payload(payload.read_payload(spark, f"{out}/model"))
    check = evaluation.verify_scores(probs, scoring.score(held, saved, key), model.classes, saved.classes, key)
    return Trained(spec, model, evaluation.report(pairs), evaluation.confusion(pairs, model.classes), check)
