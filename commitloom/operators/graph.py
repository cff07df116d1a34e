"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from commitloom import scratch

#: Edges that one written file holds, about; a few files at least.
EDGES_A_FILE, LEAST_FILES = 500_000, 4


def _written(edges: DataFrame, about: int | None) -> tuple[DataFrame, str, tuple]:
    """Different edges, written: the table, its path, and what tells it from another. ``about``: how many there may be."""
    seen = Observation()
    h = F.xxhash64("u", "v")
    rows = edges.distinct()
    if about is not None:
        rows = rows.coalesce(max(LEAST_FILES, -(-about // EDGES_A_FILE)))
    kept, path = scratch.keep(rows.observe(seen, F.count("*").alias("n"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("x"), F.coalesce(F.sum(F.shiftright(h, 24)), F.lit(0)).alias("s")))
    return kept, path, (seen.get["n"], seen.get["x"], seen.get["s"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in ``edges`` (u, v: two longs); component is the smallest node.

    Null ends and loops are ignored; repeated edges count once; no edges give no rows. An edge never becomes
    more than one, and rounds grow with the logarithm of the longest path. In a round each edge's smaller end
    moves to that end's smallest neighbour, then each node's edges move to its own smallest; smallest
    neighbours are found behind partial aggregates, so a node with very many neighbours is one row of each
    task, and the join on it can be split. Every round is written to the shared folder.
    """
    spark = edges.sparkSession
    ordered = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now, path, mark = _written(ordered, None)
    while mark[0]:
        ends = F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("v").alias("m")), F.struct("v", F.least("u", "v").alias("m")), F.struct(F.col("v").alias("v"), F.col("u").alias("m"))))
        low = now.select(ends.alias("e")).select("e.*").groupBy("v").agg(F.min("m").alias("m"))
        large = now.join(low, "v").select("u", F.least("v", "m").alias("v")).repartition("u")
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(floor, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        after, after_path, then = _written(moved.union(floor.select("u", F.col("m").alias("v"))), mark[0])
        scratch.drop(spark, path)
        now, path = after, after_path
        if then == mark:
            break
        mark = then
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
