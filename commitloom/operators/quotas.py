"""Quotas and limits in arrival order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitloom.functions import text as T
from commitloom.operators.firsts import BUCKETS, mark_first


def cap_per_label(df: DataFrame, cap: int, label: str = "label") -> DataFrame:
    """The first ``cap`` rows of each label by seq; all of them if it is 0. Rows without seq are left out by a cap."""
    if not cap:
        return df
    ends = df.agg(F.min("seq").alias("low"), F.max("seq").alias("high")).first()
    if ends.low is None:
        return df.where("seq is not null")
    width = (ends.high - ends.low) // BUCKETS + 1
    bucket = F.floor((F.col("seq") - ends.low) / width)
    return mark_first(df, label, bucket, [F.col("seq")], lambda _: F.lit(cap), "_first").where("_first").drop("_first")


def apply_quota(df: DataFrame, per_label: int = 0, limit: int = 100_000) -> DataFrame:
    """The cap of each label, then the total limit, both by seq."""
    return cap_per_label(df, per_label).orderBy("seq").limit(limit)


def quota_counts(df: DataFrame, per_label: int, limit: int) -> DataFrame:
    """One row: kept rows, and those that their label's cap held back before the limit was met."""
    kept = apply_quota(df, per_label, limit).agg(F.count("*").alias("kept"), F.max("seq").alias("last"))
    seen = df.crossJoin(F.broadcast(kept)).where((F.col("kept") < limit) | (F.col("seq") <= F.col("last"))).agg(F.count("*").alias("seen"))
    return kept.crossJoin(seen).select("kept", (F.col("seen") - F.col("kept") if per_label else F.lit(0).cast("long")).alias("capped"))


def mined(log: DataFrame, limit: int | None = None) -> DataFrame:
    """The conventional ones of the newest 2 * limit commits (all without a limit), at most ``limit``, with their label."""
    recent = log.orderBy("seq").limit(2 * limit) if limit else log
    labelled = recent.withColumn("label", T.conventional_label(F.col("subject"))).where(F.col("label").isNotNull())
    return labelled.orderBy("seq").limit(limit) if limit else labelled


def label_counts(df: DataFrame, out: str = "n", label: str = "label") -> DataFrame:
    return df.where(F.coalesce(F.col(label), F.lit("")) != "").groupBy(label).agg(F.count("*").alias(out))
