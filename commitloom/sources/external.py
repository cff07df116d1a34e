"""External collections of commits: files in the shapes of known sources to commit records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commitloom.operators import ingest, quotas
from commitloom.schema import ALIASES, MODS
from commitloom.sources import records

#: What is read of each source's rows.
SCHEMAS = {"commitchronicle": MODS, "commitbench": ALIASES}


def read_external(spark: SparkSession, items: list[str], source: str) -> DataFrame:
    """seq and the source's fields of all rows in files or folders of JSON lines or arrays, or of Parquet (by its suffix, or a folder's).

    Fields that the files don't have are null; others aren't read. Parquet rows are numbered in the order in
    which they are read.
    """
    if source not in SCHEMAS:
        raise ValueError(f"unknown source {source!r}; known are {sorted(SCHEMAS)}")
    schema = T.StructType.fromDDL(SCHEMAS[source])
    columnar = [x for x in items if x.rstrip("/").endswith(".parquet")]
    out = records.read_records(spark, [x for x in items if x not in columnar], schema)
    if columnar:
        rows = spark.read.schema(schema).parquet(*columnar).withColumn("seq", F.monotonically_increasing_id() + (len(items) << 48))
        out = out.unionByName(rows)
    return out


def import_external(spark: SparkSession, items: list[str], source: str, out: str | None = None, per_label: int = 0, limit: int = 100_000, append: bool = False) -> DataFrame:
    """Commit records of an external collection: read, normalized, at most ``per_label`` of each label and ``limit`` in all by seq.

    With ``out`` they are also written there as JSON lines.
    """
    kept = quotas.apply_quota(ingest.normalize(read_external(spark, items, source), source), per_label, limit)
    if out:
        records.write_jsonl(kept, out, append, "seq")
    return kept
