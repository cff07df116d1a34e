"""The first rows of each group, without sorting whole groups: a few groups may hold all rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets that the order is cut into.
BUCKETS = 4_096


def mark_first(df: DataFrame, group: str, bucket: Column, order: list[Column], quota: Callable[[Column], Column], out: str) -> DataFrame:
    """``df`` with ``out``: whether a row is among its group's first ``quota(size of the group)`` by ``order``.

    ``bucket`` must never fall while ``order`` rises. Rows of each (group, bucket) are counted behind partial
    aggregates; only the bucket of each group in which the quota ends is sorted. Null is a group of its own.
    """
    names = df.columns
    rows = df.withColumn("_bucket", bucket)
    counts = rows.groupBy(F.col(group).alias("_group"), "_bucket").agg(F.count("*").alias("_n"))
    own = Window.partitionBy("_group")
    before = F.coalesce(F.sum("_n").over(own.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("_before", before).withColumn("_quota", quota(F.sum("_n").over(own))).withColumnRenamed("_bucket", "_b")
    rows = rows.join(counts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_bucket") == F.col("_b")))
    split = (F.col("_before") < F.col("_quota")) & (F.col("_before") + F.col("_n") > F.col("_quota"))
    plain = rows.where(~split).select(*names, (F.col("_before") < F.col("_quota")).alias(out))
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return plain.union(rows.where(split).select(*names, (F.col("_before") + place <= F.col("_quota")).alias(out)))


def with_place(df: DataFrame, group: str, bucket: Column, order: list[Column], out: str) -> DataFrame:
    """``df`` with ``out``: a row's place (from 1) in its group by ``order``, each (group, bucket) sorted on its own.

    ``bucket`` must never fall while ``order`` rises.
    """
    names = df.columns
    rows = df.withColumn("_bucket", bucket)
    counts = rows.groupBy(F.col(group).alias("_group"), F.col("_bucket").alias("_b")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_group").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_group", "_b", before.alias("_before"))
    place = F.row_number().over(Window.partitionBy(group, "_bucket").orderBy(*order))
    placed = rows.withColumn("_place_in", place).join(counts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_bucket") == F.col("_b")))
    return placed.select(*names, (F.col("_before") + F.col("_place_in")).alias(out))
