"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch are worked on in blocks of at most so many characters (one row at least).
BLOCK_CHARS = 4_000_000

#: A cache of words is emptied when it holds so many, which bounds a worker's memory.
CACHE_WORDS = 300_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(batch: pa.RecordBatch, column: str = "text", most: int = BLOCK_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about ``most`` bytes."""
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for i, n in enumerate(lengths):
        if total + n > most and i > at:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    if at < len(lengths):
        yield batch.slice(at)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a block, null as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def by_block(make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], column: str = "text", most: int = BLOCK_CHARS):
    """A function for mapInArrow: ``make`` is called once a task, what it returns once a block."""

    def run(batches):
        work = make()
        for batch in batches:
            for block in blocks(batch, column, most):
                yield work(block)

    return run


def record(schema: list[tuple[str, pa.DataType]], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], names=[n for n, _ in schema])


def mix64(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them (splitmix64's finalizer)."""
    x = x.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def one_of_each(rows: DataFrame) -> DataFrame:
    """Of rows of equal doc_id the one whose other columns sort first, nulls before all."""
    rest = [c for c in rows.columns if c != "doc_id"]
    return rows.groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("_rest")).select("doc_id", "_rest.*").select(*rows.columns)


def sample(docs: DataFrame, n: int, salt: int = 0, each: Callable[[DataFrame], DataFrame] = lambda chosen: chosen) -> DataFrame:
    """At most n rows of ``docs``: those whose doc_id has the smallest hashes, one of each. Only ids are sorted; n ids are broadcast.

    ``each`` may make smaller rows of those chosen, one of each, where they lie.
    """
    ids = docs.select("doc_id").where(F.col("doc_id").isNotNull()).distinct().orderBy(F.xxhash64(F.lit(salt), "doc_id"), "doc_id").limit(n)
    return one_of_each(each(docs.join(F.broadcast(ids), "doc_id", "left_semi")))
