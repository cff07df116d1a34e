"""Git history as a data source: one partition for each repository, and what commits show, on the executors."""

from __future__ import annotations

import subprocess

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from commitloom import scratch
from commitloom.functions import text as T
from commitloom.operators import ingest


#: What a log line holds, and what stands between its fields.
LOG_FORMAT, LOG_SIGN = "%H|~|%at|~|%s", "|~|"


def run_git(arguments: list[str], folder: str) -> str | None:
    """Stripped output of a git command, undecodable bytes replaced; null if it fails."""
    try:
        done = subprocess.run(["git", *arguments], cwd=folder, capture_output=True, encoding="utf-8", errors="replace", check=False)
    except OSError:
        return None
    return done.stdout.strip() if done.returncode == 0 else None


class _Repository(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _LogReader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options.get("path", "").split(",") if p]
        self.limit = int(options.get("limit", 0))

    def partitions(self):
        return [_Repository(p) for p in self.paths]

    def read(self, partition):
        most = ["-n", str(2 * self.limit)] if self.limit else []
        log = run_git(["log", f"--pretty=format:{LOG_FORMAT}", "--no-merges", *most], partition.path) or ""
        for seq, line in enumerate(log.splitlines()):
            parts = line.split(LOG_SIGN, 2)
            if len(parts) == 3:
                yield partition.path, seq, *parts


class GitLog(DataSource):
    """``spark.read.format("gitlog").option("path", "repo,repo").option("limit", n)``: newest commits first."""

    @classmethod
    def name(cls):
        return "gitlog"

    def schema(self):
        return "path string, seq long, sha string, epoch string, subject string"

    def reader(self, schema):
        return _LogReader(self.options)


def read_log(spark: SparkSession, repos: list[str], limit: int | None = None) -> DataFrame:
    spark.dataSource.register(GitLog)
    return spark.read.format("gitlog").option("path", ",".join(repos)).option("limit", str(limit or 0)).load()


def with_shows(log: DataFrame) -> DataFrame:
    """The log's columns with stat (numstat text) and diff of each commit; commits that git can't show are dropped."""
    schema = StructType([*log.schema.fields, StructField("stat", StringType()), StructField("diff", StringType())])

    def run(batches):
        for batch in batches:
            shows = [
                (run_git(["show", sha, "--numstat", "--format="], path), run_git(["show", sha, "--no-color"], path))
                for path, sha in zip(batch.column("path").to_pylist(), batch.column("sha").to_pylist(), strict=True)
            ]
            kept = [stat is not None and bool(diff) for stat, diff in shows]
            rows = batch.filter(pa.array(kept))
            some = [s for s, k in zip(shows, kept, strict=True) if k]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([s for s, _ in some], pa.string()), pa.array([d for _, d in some], pa.string())], names=[*batch.schema.names, "stat", "diff"])

    return log.mapInArrow(run, schema)


def mine(spark: SparkSession, repos: list[str], limit: int | None = None) -> DataFrame:
    """Commit records of local repositories. The header decides before a diff is fetched."""
    log = read_log(spark, repos, limit).withColumn("label", T.conventional_label(F.col("subject"))).where("label is not null")
    if limit:
        log = log.withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy("seq"))).where(F.col("_n") <= limit).drop("_n")
    # written, as no filter or second reading may run git again
    shown, _ = scratch.keep(with_shows(log.repartition("path", "sha")))
    return ingest.mined_records(shown, F.substring_index(F.regexp_replace("path", "/+$", ""), "/", -1))
