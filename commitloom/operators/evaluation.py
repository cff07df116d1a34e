"""Splits, reports, confusion matrices and parity of predictions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commitloom.operators.firsts import mark_first
from commitloom.operators.scoring import Model


def shuffled(seed: int, key: str) -> Column:
    """What a seeded shuffle sorts by: the same on every run and every cluster."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def stratified_split(df: DataFrame, share: float = 0.1, seed: int = 42, label: str = "label", key: str = "seq") -> DataFrame:
    """``df`` with is_test: of each label the rounded share with the smallest hashes of key and seed."""
    mixed = shuffled(seed, key)
    bucket = F.conv(F.substring(mixed, 1, 3), 16, 10).cast("long")
    return mark_first(df, label, bucket, [mixed, F.col(key)], lambda n: F.round(n * share), "is_test")


def seeded_head(df: DataFrame, n: int, seed: int, key: str = "seq") -> DataFrame:
    """The n rows that a shuffle by hashes of key and seed puts first."""
    return df.orderBy(shuffled(seed, key), key).limit(n)


def report(pairs: DataFrame) -> DataFrame:
    """label, precision, recall, f1, support of rows (y, pred), with accuracy and the macro and weighted means.

    Each row gives two counts before the one shuffle, on label. What would divide by 0 is 0.
    """
    sides = F.explode(F.array(F.struct(F.col("y").alias("label"), (F.col("y") == F.col("pred")).cast("int").alias("hit"), F.lit(1).alias("real"), F.lit(0).alias("said")), F.struct(F.col("pred").alias("label"), F.lit(0).alias("hit"), F.lit(0).alias("real"), F.lit(1).alias("said"))))
    per = pairs.select(sides.alias("s")).select("s.*").groupBy("label").agg(F.sum("hit").alias("hit"), F.sum("real").alias("support"), F.sum("said").alias("said"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = ratio(F.col("hit"), F.col("said")), ratio(F.col("hit"), F.col("support"))
    per = per.select("label", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), "support", "hit")
    stats = ["precision", "recall", "f1"]
    total = F.sum("support")
    means = per.agg(
        F.struct(*[F.avg(c).alias(c) for c in stats]).alias("macro"), F.struct(*[ratio(F.sum(F.col(c) * F.col("support")), total).alias(c) for c in stats]).alias("weighted"),
        ratio(F.sum("hit"), total).alias("accuracy"), total.alias("support"),
    )
    row = lambda name, *cols: means.select(F.lit(name).alias("label"), *cols, "support")
    out = per.select("label", *stats, "support")
    out = out.union(row("accuracy", *[F.col("accuracy").alias(c) for c in stats]))
    return out.union(row("macro avg", *[F.col(f"macro.{c}") for c in stats])).union(row("weighted avg", *[F.col(f"weighted.{c}") for c in stats]))


def confusion(pairs: DataFrame, labels: list[str]) -> DataFrame:
    """A row for each true label in ``labels`` (sorted), a column for each predicted one, zeros filled in."""
    labels = sorted(labels)
    counts = pairs.groupBy("y").agg(*[F.count_if(F.col("pred") == x).alias(x) for x in labels])
    every = pairs.sparkSession.createDataFrame([(x,) for x in labels], "y string")
    return every.join(counts, "y", "left").na.fill(0)


def parity(left: DataFrame, right: DataFrame, key: str, value: str, tolerance: float = 1e-6) -> DataFrame:
    """n, max_abs_diff, over_tolerance, ok of two versions of a value; a row that one side lacks is over the tolerance."""
    both = left.select(key, F.col(value).alias("a"), F.lit(1).alias("_left")).join(right.select(key, F.col(value).alias("b"), F.lit(1).alias("_right")), key, "full")
    difference = F.abs(F.col("a") - F.col("b"))
    over = (difference > tolerance) | F.col("_left").isNull() | F.col("_right").isNull()
    return both.agg(F.count("*").alias("n"), F.max(difference).alias("max_abs_diff"), F.count_if(over).alias("over_tolerance")).withColumn("ok", F.col("over_tolerance") == 0)


def verify_scores(left: DataFrame, right: DataFrame, left_classes: list[str], right_classes: list[str], key: str = "seq", tolerance: float = 1e-6) -> DataFrame:
    """n, max_abs_diff, over_tolerance, same_classes, ok of two versions of each row's array ``probs``.

    A row counts once, by its largest difference. Other classes, or the same in another order, are never ok,
    and neither are rows whose arrays differ in length or that one side lacks.
    """
    both = left.select(key, F.col("probs").alias("a")).join(right.select(key, F.col("probs").alias("b")), key, "full")
    largest = F.when(F.size("a") == F.size("b"), F.array_max(F.zip_with("a", "b", lambda x, y: F.abs(x - y)))).otherwise(F.lit(float("inf")))
    found = both.select(F.coalesce(largest, F.lit(0.0)).alias("d")).agg(F.count("*").alias("n"), F.max("d").alias("max_abs_diff"), F.count_if(F.col("d") > tolerance).alias("over_tolerance"))
    return found.withColumn("same_classes", F.lit(left_classes == right_classes)).withColumn("ok", F.col("same_classes") & (F.col("over_tolerance") == 0))


def at_minimum(rows: DataFrame, model: Model, tolerance: float = 1e-6) -> DataFrame:
    """fold, label, taught, calibrated, share, at_minimum: how far from their minimum a model's coefficients are for its training rows.

    ``rows``: (label, fold, indices, values). ``share`` is the length of the gradient of |w|^2 / 2 + sum of
    cost * max(0, 1 - y * (x w))^2 at the coefficients, by its length at 0. Features of a row meet the
    coefficients, one row for each feature, by a join.
    """
    spark, width = rows.sparkSession, model.folds[0].coef.shape[1]
    weights = [(f, c, i, float(v)) for f, fold in enumerate(model.folds) for c in range(len(model.classes)) for i, v in [*((int(j), fold.coef[c][j]) for j in np.flatnonzero(fold.coef[c])), (width, fold.intercept[c])]]
    w = spark.createDataFrame(weights, "f int, c int, idx int, w double")
    label = F.array_position(F.array(*map(F.lit, model.classes)), F.col("label")).cast("int") - 1
    one = F.struct(F.lit(width).alias("idx"), F.lit(1.0).alias("value"))
    x = rows.withColumn("_id", F.monotonically_increasing_id()).select("_id", label.alias("_label"), "fold", F.explode(F.concat(F.array(one), F.arrays_zip(F.col("indices").alias("idx"), F.col("values").alias("value")))).alias("x")).select("_id", "_label", "fold", "x.*")
    counts = rows.groupBy("label", "fold").agg(F.count("*").alias("n"))
    sizes = counts.agg(F.sum("n")).first()[0]
    ns = {(r.label, r.fold): r.n for r in counts.collect()}
    per = []
    for f in range(len(model.folds)):
        n = sizes - sum(v for (_, g), v in ns.items() if g == f)
        for c, name in enumerate(model.classes):
            own = ns.get((name, f), 0)
            taught = sum(v for (k, _), v in ns.items() if k == name) - own
            per.append((f, c, name, taught, own, n / (len(model.classes) * taught) if taught else 0.0))
    problems = F.broadcast(spark.createDataFrame(per, "f int, c int, label string, taught long, calibrated long, weight double"))
    margin = x.join(F.broadcast(w), "idx").where("fold <> f").groupBy("_id", "_label", "f", "c").agg(F.sum(F.col("value") * F.col("w")).alias("margin"))
    mine = F.col("_label") == F.col("c")
    sign, cost = F.when(mine, 1.0).otherwise(-1.0), F.when(mine, F.col("weight")).otherwise(1.0)
    pull = margin.join(problems, ["f", "c"]).select("_id", "f", "c", (-2 * sign * cost * F.greatest(F.lit(0.0), 1 - sign * F.col("margin"))).alias("here"), (-2 * sign * cost).alias("at_zero"))
    sums = x.select("_id", "idx", "value").join(pull, "_id").groupBy("f", "c", "idx").agg(F.sum(F.col("value") * F.col("here")).alias("here"), F.sum(F.col("value") * F.col("at_zero")).alias("at_zero"))
    both = sums.join(F.broadcast(w), ["f", "c", "idx"], "left").select("f", "c", (F.col("here") + F.coalesce("w", F.lit(0.0))).alias("here"), "at_zero")
    lengths = both.groupBy("f", "c").agg(F.sqrt(F.sum(F.col("here") ** 2)).alias("here"), F.sqrt(F.sum(F.col("at_zero") ** 2)).alias("at_zero"))
    share = F.coalesce(F.col("here") / F.nullif(F.col("at_zero"), F.lit(0.0)), F.lit(0.0))
    return problems.join(lengths, ["f", "c"], "left").select(F.col("f").alias("fold"), "label", "taught", "calibrated", share.alias("share"), (share <= tolerance).alias("at_minimum"))
