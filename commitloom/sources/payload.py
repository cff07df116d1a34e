"""The portable form of a fitted model: JSON with vocabularies, scales and calibrated folds."""

from __future__ import annotations

import json
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from commitloom.operators.features import Spec
from commitloom.operators.scoring import Fold, Model

#: Fixed value: the version of the form.
VERSION = 1
#: Fixed value: the token pattern as other languages write it.
PATTERN = r"(?u)\b\w\w+\b"


def export_payload(spec: Spec, model: Model) -> dict:
    counts = lambda words: {"vocabulary": {w: i for i, w in enumerate(words)}, "token_pattern": PATTERN, "lowercase": True, "binary": True}
    return {
        "schema_version": VERSION,
        "classes": list(model.classes),
        "feature_layout": spec.layout,
        "tfidf": {"vocabulary": {w: i for i, w in enumerate(spec.terms)}, "idf": list(map(float, spec.idf)), "token_pattern": PATTERN, "lowercase": True, "norm": spec.norm, "sublinear_tf": spec.sublinear, "ngram_range": [1, 1]},
        "path_bow": counts(spec.paths),
        "ext_bow": counts(spec.exts),
        "scaler": {"mean": list(map(float, spec.mean)), "scale": list(map(float, spec.scale))},
        "calibrated_folds": [{"coef": f.coef.tolist(), "intercept": f.intercept.tolist(), "sigmoid_a": f.a.tolist(), "sigmoid_b": f.b.tolist()} for f in model.folds],
    }


def import_payload(payload: dict) -> tuple[Spec, Model]:
    """Other versions, and token patterns that are no patterns, raise ValueError; unknown keys are ignored."""
    if payload.get("schema_version") != VERSION:
        raise ValueError(f"unsupported schema_version {payload.get('schema_version')!r}")
    for part in ("tfidf", "path_bow", "ext_bow"):
        try:
            re.compile(payload[part]["token_pattern"])
        except re.error as e:
            raise ValueError(f"bad token_pattern of {part}: {e}") from e
    words = lambda part: [w for w, _ in sorted(payload[part]["vocabulary"].items(), key=lambda x: x[1])]
    tfidf, scale = payload["tfidf"], payload["scaler"]
    spec = Spec(words("tfidf"), tfidf["idf"], words("path_bow"), words("ext_bow"), scale["mean"], scale["scale"], bool(tfidf.get("sublinear_tf")), tfidf.get("norm"))
    folds = [Fold(*(np.asarray(f[k], float) for k in ("coef", "intercept", "sigmoid_a", "sigmoid_b"))) for f in payload["calibrated_folds"]]
    return spec, Model(list(payload["classes"]), folds)


def write_payload(spark: SparkSession, payload: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(payload, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_payload(spark: SparkSession, path: str) -> dict:
    """From any store that Spark reads."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def fixtures(rows: DataFrame, probs: DataFrame, key: str = "seq") -> DataFrame:
    """diff_text, numeric, expected_probs of scored rows: what another implementation is held against."""
    from pyspark.sql import functions as F

    from commitloom.operators.features import NUMBERS

    return rows.join(probs, key).select("diff_text", F.array(*NUMBERS).alias("numeric"), F.col("probs").alias("expected_probs"))
