"""Features and classifier as stages of a ``pyspark.ml`` pipeline: estimators and models with parameters, saved and loaded as one.

    model = Pipeline(stages=[DiffFeatures(), CalibratedSVC()]).fit(rows)
    model.write().overwrite().save(path)
    PipelineModel.load(path).transform(rows)

Rows carry a key, a diff and counts of files and lines, and to be learned from a label. What a stage has learned is
saved as Parquet beside its parameters.
"""

from __future__ import annotations

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commitloom.operators import features, scoring, training
from commitloom.schema import MAX_DIFF


class _Keyed(Params):
    keyCol = Param(Params._dummy(), "keyCol", "column that tells rows apart", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(keyCol="seq")

    def setParams(self, **values):
        return self._set(**values)

    def getKeyCol(self) -> str:
        return self.getOrDefault(self.keyCol)


class _Sizes(_Keyed):
    maxTerms = Param(Params._dummy(), "maxTerms", "terms of the TF-IDF vocabulary at most", TypeConverters.toInt)
    maxPaths = Param(Params._dummy(), "maxPaths", "parts of paths at most", TypeConverters.toInt)
    maxExts = Param(Params._dummy(), "maxExts", "extensions at most", TypeConverters.toInt)
    maxDiff = Param(Params._dummy(), "maxDiff", "code points of a diff that are read", TypeConverters.toInt)
    stopWords = Param(Params._dummy(), "stopWords", "words that are no terms; if not set, the English list", TypeConverters.toListString)

    def __init__(self):
        super().__init__()
        self._setDefault(maxTerms=features.MAX_TERMS, maxPaths=features.MAX_PATHS, maxExts=features.MAX_EXTS, maxDiff=MAX_DIFF)

    def _inputs(self, rows: DataFrame) -> DataFrame:
        return features.inputs(rows, self.getOrDefault(self.maxDiff))


class _Writer(MLWriter):
    """Writes parameters as the library's own stages do, and ``tables`` of the instance as Parquet."""

    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        for name, table in self.instance._tables(self.sparkSession).items():
            table.write.parquet(f"{path}/{name}")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        made = self.cls._of(lambda name: self.sparkSession.read.parquet(f"{path}/{name}"))
        made._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(made, metadata)
        return made


class _Saved(MLWritable, MLReadable):
    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class DiffFeatures(Estimator, _Sizes, DefaultParamsReadable, DefaultParamsWritable):
    """Fits vocabularies and scales: see ``features.fit``. Its model adds indices and values to rows."""

    @keyword_only
    def __init__(self, *, keyCol="seq", maxTerms=features.MAX_TERMS, maxPaths=features.MAX_PATHS, maxExts=features.MAX_EXTS, maxDiff=MAX_DIFF, stopWords=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, rows: DataFrame) -> DiffFeaturesModel:
        words = self.getOrDefault(self.stopWords) if self.isSet(self.stopWords) else None
        get = lambda p: self.getOrDefault(p)
        spec = features.fit(self._inputs(rows), words, get(self.maxTerms), get(self.maxPaths), get(self.maxExts))
        return self._copyValues(DiffFeaturesModel(spec))


class DiffFeaturesModel(Model, _Sizes, _Saved):
    """Adds indices and values, in the layout of its spec; the width stands in the metadata of indices."""

    def __init__(self, spec: features.Spec | None = None):
        super().__init__()
        self.spec = spec

    def _transform(self, rows: DataFrame) -> DataFrame:
        key = self.getKeyCol()
        found = features.transform(self._inputs(rows.drop("indices", "values")), self.spec, key)
        out = rows.drop("indices", "values").join(found, key)
        return out.withMetadata("indices", {"width": self.spec.width})

    def _tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        s = self.spec
        words = [(part, i, w, float(v)) for part, ws, vs in (("tfidf", s.terms, s.idf), ("path", s.paths, [1.0] * len(s.paths)), ("ext", s.exts, [1.0] * len(s.exts))) for i, (w, v) in enumerate(zip(ws, vs, strict=True))]
        scales = [(i, float(m), float(v)) for i, (m, v) in enumerate(zip(s.mean, s.scale, strict=True))]
        return {
            "words": spark.createDataFrame(words, "part string, idx int, word string, idf double"),
            "scales": spark.createDataFrame(scales, "idx int, mean double, scale double"),
            "weighting": spark.createDataFrame([(s.sublinear, s.norm)], "sublinear boolean, norm string"),
        }

    @classmethod
    def _of(cls, table) -> DiffFeaturesModel:
        # as many rows as the vocabularies' sizes
        rows = table("words").orderBy("part", "idx").collect()
        of = lambda part: [r for r in rows if r["part"] == part]
        scales, weighting = table("scales").orderBy("idx").collect(), table("weighting").first()
        words = lambda part: [r["word"] for r in of(part)]
        return cls(features.Spec(words("tfidf"), [r["idf"] for r in of("tfidf")], words("path"), words("ext"), [r["mean"] for r in scales], [r["scale"] for r in scales], weighting["sublinear"], weighting["norm"]))


class _Labelled(_Keyed):
    labelCol = Param(Params._dummy(), "labelCol", "column of labels; rows without one teach nothing", TypeConverters.toString)
    folds = Param(Params._dummy(), "folds", "folds of the calibration", TypeConverters.toInt)
    maxIter = Param(Params._dummy(), "maxIter", "Newton steps at most", TypeConverters.toInt)

    def __init__(self):
        super().__init__()
        self._setDefault(labelCol="label", folds=training.FOLDS, maxIter=100)


class CalibratedSVC(Estimator, _Labelled, DefaultParamsReadable, DefaultParamsWritable):
    """Fits the calibrated classifier: see ``training.fit``. Its model adds probs and prediction to rows."""

    @keyword_only
    def __init__(self, *, keyCol="seq", labelCol="label", folds=training.FOLDS, maxIter=100):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, rows: DataFrame) -> CalibratedSVCModel:
        width = rows.schema["indices"].metadata.get("width") or (rows.agg(F.max(F.array_max("indices"))).first()[0] or 0) + 1
        label = F.nullif(F.col(self.getOrDefault(self.labelCol)), F.lit(""))
        vectors = rows.select(self.getKeyCol(), label.alias("label"), "indices", "values")
        model = training.fit(vectors, width, folds=self.getOrDefault(self.folds), max_iter=self.getOrDefault(self.maxIter), key=self.getKeyCol())
        return self._copyValues(CalibratedSVCModel(model))


class CalibratedSVCModel(Model, _Labelled, _Saved):
    """Adds probs, in the order of ``classes``, and prediction, the best of them."""

    def __init__(self, model: scoring.Model | None = None):
        super().__init__()
        self.model = model

    @property
    def classes(self) -> list[str]:
        return self.model.classes

    def _transform(self, rows: DataFrame) -> DataFrame:
        rows, key = rows.drop("probs", "prediction"), self.getKeyCol()
        out = rows.join(scoring.score(rows, self.model, key), key)
        return out.withColumn("prediction", scoring.best(F.col("probs"), self.classes, 1)[0]["label"]) if self.classes else out.withColumn("prediction", F.lit(None).cast("string"))

    def _tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        rows = [(f, c, label, fold.coef[c].tolist(), float(fold.intercept[c]), float(fold.a[c]), float(fold.b[c])) for f, fold in enumerate(self.model.folds) for c, label in enumerate(self.classes)]
        return {"coefficients": spark.createDataFrame(rows, "fold int, class int, label string, coef array<double>, intercept double, a double, b double")}

    @classmethod
    def _of(cls, table) -> CalibratedSVCModel:
        rows = table("coefficients").orderBy("fold", "class").collect()  # one row a class and fold
        folds = []
        for f in sorted({r["fold"] for r in rows}):
            own = [r for r in rows if r["fold"] == f]
            folds.append(scoring.Fold(np.array([r["coef"] for r in own]), *(np.array([r[k] for r in own]) for k in ("intercept", "a", "b"))))
        return cls(scoring.Model([r["label"] for r in rows if r["fold"] == 0], folds))
