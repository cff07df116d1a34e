"""De-duplication against earlier runs: an index of the keys that have been seen, kept between batches.

The index is a list of runs. Each holds keys in a table that is bucketed and sorted by them, so that looking up a
batch moves the batch's keys and never the index, and a Bloom filter for each part of its keys, so that most new keys
need no look at the table at all. Every batch adds a run; runs of like size are merged, so that there are only
as many as the logarithm of the keys. A manifest, written under a new number and never changed, says which runs
count: a batch that fails leaves the index as it was, and the last one may be run again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commitloom import scratch
from commitloom.operators import dedup

#: Bits for a key, bits of one part's filter at most (with more keys it lets more through and is never wrong), bits set for a key.
BITS, MOST_BITS, HASHES = 16, 1 << 26, 4
#: A run is merged with the one before it unless that has more than so many times its keys.
RATIO = 2


def _hashed(keys: DataFrame, parts: int) -> DataFrame:
    """Keys with the part of the filter that they belong to, and two hashes that place them in it."""
    return keys.withColumns({"_part": F.pmod(F.hash("kind", "key"), F.lit(parts)), "_a": F.xxhash64(F.lit(1), "kind", "key"), "_b": F.xxhash64(F.lit(2), "kind", "key")})


def _bits(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """(keys, HASHES) places of keys in a filter of n bits, a power of two."""
    step = b.astype(np.uint64) | np.uint64(1)
    return ((a.astype(np.uint64)[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) & np.uint64(n - 1)).astype(np.int64)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices of batches that are sorted by _part, one part each."""
    for batch in batches:
        part = batch.column("_part").to_numpy()
        cuts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(part)] if len(part) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield int(part[a]), batch.slice(a, b - a)


def bloom_filters(keys: DataFrame, parts: int) -> DataFrame:
    """part, bits: a filter of each part of different keys, sized by how many it has; a task holds one at a time."""
    hashed = _hashed(keys, parts)
    sizes = hashed.groupBy("_part").agg(F.count("*").alias("_n"))

    def run(batches):
        now, bits = None, np.zeros(0, bool)
        row = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["part", "bits"])
        for part, some in _parts(batches):
            if part != now:
                if now is not None:
                    yield row()
                n = some.column("_n")[0].as_py()
                now, bits = part, np.zeros(min(MOST_BITS, max(64, 1 << (n * BITS - 1).bit_length())), bool)
            bits[_bits(some.column("_a").to_numpy(), some.column("_b").to_numpy(), len(bits))] = True
        if now is not None:
            yield row()

    dealt = hashed.join(F.broadcast(sizes), "_part").select("_part", "_a", "_b", "_n").repartition(parts, "_part").sortWithinPartitions("_part")
    return dealt.mapInArrow(run, "part int, bits binary")


def maybe_held(keys: DataFrame, filters: DataFrame, parts: int) -> DataFrame:
    """Those of ``keys`` (kind, key) that the filters can't rule out: all that are held, and a few others."""
    hashed = _hashed(keys.select("kind", "key"), parts).withColumn("bits", F.lit(None).cast("binary"))
    first = filters.select(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("key"), F.col("part").alias("_part"), F.lit(0).cast("long").alias("_a"), F.lit(0).cast("long").alias("_b"), "bits")

    def run(batches):
        now, bits = None, None
        for part, some in _parts(batches):
            if part != now:
                now, bits = part, None
            at = 0
            if some.column("bits")[0].is_valid:  # the filter comes before its part's keys
                bits, at = np.unpackbits(np.frombuffer(some.column("bits")[0].as_buffer(), np.uint8)).astype(bool), 1
            some = some.slice(at)
            if bits is not None and len(some):
                hit = bits[_bits(some.column("_a").to_numpy(), some.column("_b").to_numpy(), len(bits))].all(axis=1)
                yield some.select(["kind", "key"]).filter(pa.array(hit))

    dealt = first.unionByName(hashed).repartition(parts, "_part").sortWithinPartitions("_part", F.col("bits").isNull())
    return dealt.mapInArrow(run, "kind string, key string")


class SeenKeys:
    """An index of different keys (kind, key) in a folder that all executors share.

    ``parts``: buckets of a run's table, and of its filters, when the index is made; None: as many as the session's
    shuffles have. An index that exists keeps its own.
    """

    def __init__(self, spark: SparkSession, path: str, parts: int | None = None):
        self.spark, self.path = spark, path
        self._fs_path = lambda x: spark._jvm.org.apache.hadoop.fs.Path(x)
        self._fs = self._fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.number, state = self._latest()
        self.parts, self.runs = state["parts"] if state else parts or int(spark.conf.get("spark.sql.shuffle.partitions")), state["runs"] if state else []

    def _latest(self) -> tuple[int, dict | None]:
        found = [s.getPath() for s in self._fs.globStatus(self._fs_path(f"{self.path}/manifest-*.json")) or []]
        if not found:
            return 0, None
        last = max(found, key=lambda p: p.getName())
        return int(last.getName()[9:-5]), json.loads(self.spark.read.text(last.toString(), wholetext=True).first()[0])

    def _commit(self, runs: list[dict]) -> None:
        """Make ``runs`` what counts; of two writers of one number the second fails."""
        self.number += 1
        draft, final = (self._fs_path(f"{self.path}/{name}") for name in (f"draft-{uuid.uuid4().hex}", f"manifest-{self.number:08d}.json"))
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps({"parts": self.parts, "runs": runs}).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise RuntimeError(f"{final} was written by another run")
        self.runs = runs

    def _table(self, run: dict) -> DataFrame:
        """A run's keys, as a table that Spark knows the buckets of."""
        if not self.spark.catalog.tableExists(run["name"]):
            self.spark.sql(f"CREATE TABLE {run['name']} (kind STRING, key STRING) USING parquet CLUSTERED BY (kind, key) SORTED BY (kind, key) INTO {self.parts} BUCKETS LOCATION '{self.path}/{run['name']}/keys'")
        return self.spark.table(run["name"])

    def _filters(self, run: dict) -> DataFrame:
        return self.spark.read.schema("part int, bits binary").parquet(f"{self.path}/{run['name']}/filters")

    def _write(self, keys: DataFrame, batches: list[str]) -> dict:
        """A run of different keys. One task writes each bucket, as one sorted file."""
        name = f"seen_{uuid.uuid4().hex}"
        rows = keys.select("kind", "key").repartition(self.parts, "kind", "key").write.bucketBy(self.parts, "kind", "key").sortBy("kind", "key")
        rows.option("path", f"{self.path}/{name}/keys").saveAsTable(name)
        held = self.spark.table(name)
        bloom_filters(held, self.parts).write.parquet(f"{self.path}/{name}/filters")
        return {"name": name, "batches": batches, "n": held.count()}

    def _forget(self, runs: list[dict]) -> None:
        for run in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {run['name']}")
            scratch.drop(self.spark, f"{self.path}/{run['name']}")

    def begin(self, batch: str) -> None:
        """Before a batch: one that was added last, and not merged since, is taken back and may be run again; an older one raises."""
        if self.runs and self.runs[-1]["batches"] == [batch]:
            gone = self.runs[-1:]
            self._commit(self.runs[:-1])
            self._forget(gone)
        elif any(batch in run["batches"] for run in self.runs):
            raise ValueError(f"batch {batch!r} is part of the index")

    def seen(self, keys: DataFrame) -> DataFrame:
        """Those of the different ``keys`` (kind, key) that the index holds."""
        out = self.spark.createDataFrame([], "kind string, key string")
        for run in self.runs:
            out = out.union(maybe_held(keys, self._filters(run), self.parts).join(self._table(run), ["kind", "key"], "left_semi"))
        return out

    def add(self, keys: DataFrame, batch: str) -> None:
        """Add different keys that the index doesn't hold, as those of one batch. Earlier runs of like size are merged first."""
        runs, gone = list(self.runs), []
        while len(runs) > 1 and runs[-2]["n"] <= RATIO * runs[-1]["n"]:
            one, other = runs[-2:]
            gone += [one, other]
            runs[-2:] = [self._write(self._table(one).union(self._table(other)), one["batches"] + other["batches"])]
        self._commit([*runs, self._write(keys, [batch])])
        self._forget([r for r in gone if r not in self.runs])


def deduplicate_batch(commits: DataFrame, index: SeenKeys, batch: str) -> DataFrame:
    """``commits`` with norm_md5 and drop_reason, as ``dedup.with_drop_reason``, rows of earlier batches counting as seen; adds the batch to the index.

    All shas of a batch are claimed, and the diffs of rows that stay. Batches in order give the reasons that all rows
    at once would. An empty batch adds an empty run.
    """
    index.begin(batch)
    keys, path = scratch.keep(dedup.keys_of(commits))
    sha = F.to_json(F.array("_repo", "_sha"))
    shas = keys.where("_sha <> ''").select("_repo", "_sha", F.lit("sha").alias("kind"), sha.alias("key")).distinct()
    diffs = keys.where("norm_md5 is not null").select(F.lit("diff").alias("kind"), F.col("norm_md5").alias("key")).distinct()
    seen, seen_path = scratch.keep(index.seen(shas.select("kind", "key").union(diffs)))
    known_shas = shas.join(seen, ["kind", "key"], "left_semi").select("_repo", "_sha")
    known_diffs = seen.where("kind = 'diff'").select(F.col("key").alias("norm_md5"))
    reasons, _ = scratch.keep(dedup.reasons(keys, known_shas, known_diffs))
    kept = reasons.where("drop_reason is null").select(F.lit("diff").alias("kind"), F.col("norm_md5").alias("key"))
    index.add(shas.select("kind", "key").join(seen, ["kind", "key"], "left_anti").union(kept), batch)
    for gone in (path, seen_path):
        scratch.drop(index.spark, gone)
    return commits.join(reasons, "seq", "left")
