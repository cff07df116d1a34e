"""Chat formatting: logged snapshots that are the beginning of a longer conversation collapse into it.

Every turn gets a digest of all turns up to it: running XORs of hashes of (position, role, text) under
two seeds, which a window computes turn by turn. A conversation whose last digest is an earlier digest
of another one is a prefix of it. Digests are reduced to distinct ones before the anti-join, so that a
first turn which a third of all conversations share is one row of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the rendered form: what opens and closes a turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def with_prefix_digests(turns: DataFrame) -> DataFrame:
    """conv_id, position (from 1), role, text, d1, d2 of every turn."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    to_here = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = turns.where(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("position", F.row_number().over(order))
    return placed.select(
        "conv_id", "position", "role", "text",
        F.bit_xor(F.xxhash64(F.lit(17), "position", "role", "text")).over(to_here).alias("d1"),
        F.bit_xor(F.xxhash64(F.lit(71), "text", "role", "position")).over(to_here).alias("d2"),
    )


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id and n_turns of the conversations that are no proper prefix of another; of equal ones the smallest conv_id."""
    digests = with_prefix_digests(turns)
    last = Window.partitionBy("conv_id")
    ends = digests.select("conv_id", "position", "d1", "d2", F.max("position").over(last).alias("n_turns"))
    whole = ends.where("position = n_turns").groupBy("n_turns", "d1", "d2").agg(F.min("conv_id").alias("conv_id"))
    inner = ends.where("position < n_turns").select(F.col("position").alias("n_turns"), "d1", "d2").distinct()
    return whole.join(inner, ["n_turns", "d1", "d2"], "left_anti").select("conv_id", F.col("n_turns").cast("long"))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, rendered text of every maximal conversation.

    ``turns`` needs conv_id, turn, role, text; other columns are ignored. Turns are in order of turn, null
    first, then role, then text; null roles and texts count as empty; rows without conv_id are dropped;
    repeated rows are turns of their own; an empty table gives no rows. Only conversations that stay are
    gathered, each into the one row it becomes.
    """
    turns = turns.select("conv_id", "turn", "role", "text")
    piece = F.concat(F.lit(OPEN), F.col("role"), F.lit("\n"), F.col("text"), F.lit(CLOSE + "\n"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    kept = turns.join(maximal(turns), "conv_id").withColumn("position", F.row_number().over(order))
    kept = kept.select("conv_id", "n_turns", "position", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return kept.groupBy("conv_id", "n_turns").agg(
        F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("position", piece.alias("piece")))), lambda x: x["piece"])).alias("rendered")
    )
