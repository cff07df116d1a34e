"""Document fingerprints by invertible Bloom lookup sketches of paragraphs.

A text is cut into paragraphs (lines, long ones at words that their own hash picks, so that a cut moves
only with its word), and each paragraph's digest is added to one cell in each of three parts of a table:
a count, a XOR of digests and a XOR of check hashes. Subtracting two tables leaves the paragraphs that
differ; peeling cells with one paragraph recovers their digests. If that fails, both texts are sketched
again with four times the cells.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from commitloom.functions.text import let
from commitloom.llm import common

#: Cells of a fingerprint (in three parts), and how many times as many each retry has.
CELLS, GROWTH, PARTS = 24, 4, 3
#: A long line is cut after words whose hash has these many low bits clear.
CUT_BITS = 3

_WORD = re.compile(r"\s*\S+|\s+$")


def paragraphs(text: str) -> list[str]:
    """Pieces that join to the text without its line feeds; none is empty."""
    out = []
    for line in text.split("\n"):
        piece: list[str] = []
        for word in _WORD.findall(line):
            piece.append(word)
            if not xxhash.xxh32_intdigest(word.encode("utf-8", "surrogatepass")) & ((1 << CUT_BITS) - 1):
                out.append("".join(piece))
                piece = []
        if piece:
            out.append("".join(piece))
    return out


def digests(text: str) -> np.ndarray:
    """Different 64-bit digests, one for each paragraph; repeated paragraphs are told apart by their number."""
    seen: dict[str, int] = {}
    out = []
    for p in paragraphs(text):
        n = seen[p] = seen.get(p, 0) + 1
        out.append(xxhash.xxh3_64_intdigest(p.encode("utf-8", "surrogatepass"), seed=n))
    return np.unique(np.array(out, np.uint64))


def cells_of(keys: np.ndarray, cells: int) -> np.ndarray:
    """(keys, PARTS): the cell of each key in each part; another size is another hash."""
    part = cells // PARTS
    return np.stack([(common.mix64(keys, cells * PARTS + i) % np.uint64(part)).astype(np.int64) + i * part for i in range(PARTS)], axis=1)


@dataclass
class Tables:
    """Sketches of equal size, one for each row."""

    count: np.ndarray
    key: np.ndarray
    check: np.ndarray

    def minus(self, other: Tables) -> Tables:
        return Tables(self.count - other.count, self.key ^ other.key, self.check ^ other.check)

    def at(self, rows) -> Tables:
        return Tables(self.count[rows], self.key[rows], self.check[rows])


def sketch(keys: list[np.ndarray], cells: int) -> Tables:
    flat = np.concatenate(keys) if keys else np.empty(0, np.uint64)
    row = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    out = Tables(np.zeros((len(keys), cells), np.int32), np.zeros((len(keys), cells), np.uint64), np.zeros((len(keys), cells), np.uint64))
    _add(out, row, flat, np.ones(len(flat), np.int32))
    return out


def _add(t: Tables, row: np.ndarray, keys: np.ndarray, sign: np.ndarray) -> None:
    """Add keys with their signs to the rows' tables."""
    if not len(keys):
        return
    cells = t.count.shape[1]
    at = (row[:, None] * cells + cells_of(keys, cells)).ravel()
    three = lambda x: np.repeat(x, PARTS)
    np.add.at(t.count.reshape(-1), at, three(sign))
    np.bitwise_xor.at(t.key.reshape(-1), at, three(keys))
    np.bitwise_xor.at(t.check.reshape(-1), at, three(common.mix64(keys, 1)))


def peel(t: Tables) -> tuple[list[list[tuple[int, int]]], np.ndarray]:
    """For each row the recovered (digest, 1 or -1), and whether the row's table came out empty. The tables are used up."""
    found: list[list[tuple[int, int]]] = [[] for _ in t.count]
    while True:
        row, cell = np.nonzero((np.abs(t.count) == 1) & (t.check == common.mix64(t.key, 1)))
        if not len(row):
            break
        keys, sign = t.key[row, cell], t.count[row, cell]
        _, first = np.unique(np.stack([row.astype(np.uint64), keys]), axis=1, return_index=True)
        row, keys, sign = row[first], keys[first], sign[first]
        for r, k, s in zip(row.tolist(), keys.tolist(), sign.tolist(), strict=True):
            found[r].append((k, s))
        _add(t, row, keys, -sign)
    return found, ~(t.count.any(axis=1) | t.key.any(axis=1) | t.check.any(axis=1))


def differences(left: list[np.ndarray], right: list[np.ndarray], cells: int = CELLS) -> list[list[tuple[int, int]]]:
    """For each pair of digest sets the digests that differ, 1 for the left one's and -1 for the right one's."""
    out: list[list[tuple[int, int]]] = [[] for _ in left]
    todo = np.arange(len(left))
    while len(todo):
        failed = []
        # tables of one round together stay near a million cells
        step = max(1, 1_000_000 // cells)
        for at in range(0, len(todo), step):
            some = todo[at : at + step]
            found, done = peel(sketch([left[i] for i in some], cells).minus(sketch([right[i] for i in some], cells)))
            for i, f, ok in zip(some.tolist(), found, done.tolist(), strict=True):
                if ok:
                    out[i] = f
                else:
                    failed.append(i)
        todo, cells = np.array(failed, np.int64), cells * GROWTH
    return out


def likeness(left: list[np.ndarray], right: list[np.ndarray]) -> list[float]:
    """Shared paragraphs over all paragraphs of each pair; 1 for two texts without any."""
    out = []
    for a, b, d in zip(left, right, differences(left, right), strict=True):
        every = len(a) + len(b) + len(d)
        out.append((len(a) + len(b) - len(d)) / every if every else 1.0)
    return out


def written(keys: list[np.ndarray]) -> list[str]:
    """Fingerprints: how many paragraphs, and the sketch of CELLS cells in base 64."""
    t = sketch(keys, CELLS)
    rows = np.concatenate([t.count.astype("<u8"), t.key.astype("<u8"), (t.check & np.uint64(0xFFFFFFFF)).astype("<u8")], axis=1)
    narrow = [np.ascontiguousarray(r[:CELLS].astype("<u2")).tobytes() + r[CELLS : 2 * CELLS].tobytes() + r[2 * CELLS :].astype("<u4").tobytes() for r in rows]
    return [f"{len(k)}:{base64.b64encode(n).decode()}" for k, n in zip(keys, narrow, strict=True)]


def edited(text: str, after: str) -> str:
    """The text whose last third is replaced by as much of the beginning of the next one."""
    third = len(text) // 3
    return text[: len(text) - third] + after[:third]


def below(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds lie below a value: whole strides of them first, then those of one stride."""
    if not bounds:
        return F.lit(0)
    stride = math.isqrt(len(bounds)) + 1
    longs = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<bigint>")
    count = lambda xs: F.size(F.filter(xs, lambda x: x < value))
    return let(count(longs(bounds[stride - 1 :: stride])) * stride, lambda whole: whole + count(F.slice(longs(bounds), whole + 1, stride)))


def dealing_keys(spark: SparkSession, n: int) -> list[int]:
    """For each of n partitions a number that a shuffle by it sends there."""
    out: dict[int, int] = {}
    size = 8 * n + 64
    while len(out) < n:
        size *= 2
        rows = spark.range(size).groupBy(F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("at")).agg(F.min("id").alias("id"))
        out = {r["at"]: r["id"] for r in rows.collect()}
    return [out[p] for p in range(n)]


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, part, ghost: documents dealt in ranges of doc_id, null first, each range led by a copy of
    the last document of the range before it (``ghost``), the first by the last of all.

    ``part`` is a number that a shuffle by it into as many partitions as the session has sends to a partition
    of the range's own."""
    spark = docs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # at most n + 1 bounds reach the driver
    bounds = plain.where("doc_id is not null").stat.approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (8 * n)) if n > 1 else []
    bounds = sorted({int(b) for b in bounds})
    dealt = plain.withColumn("part", F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(below(F.col("doc_id"), bounds)).cast("int"))
    lasts = {r.part: r.doc_id for r in dealt.groupBy("part").agg(F.max("doc_id").alias("doc_id")).collect()}
    parts = sorted(lasts)
    follow = {p: parts[(i + 1) % len(parts)] for i, p in enumerate(parts)}
    keys = dealing_keys(spark, n)
    table = lambda of: F.get(F.array(*[F.lit(of.get(p, 0)) for p in range(n)]), F.col("part"))
    # of repeated rows the one that sorts last
    ends = spark.createDataFrame([(p, d) for p, d in lasts.items()], "part int, last long")
    is_end = F.col("doc_id").eqNullSafe(F.col("last"))
    ghosts = dealt.join(F.broadcast(ends), "part").where(is_end).groupBy("doc_id", "part").agg(F.max("text").alias("text")).select("doc_id", "text", table(follow).alias("part"), F.lit(True).alias("ghost"))
    every = dealt.withColumn("ghost", F.lit(False)).select("doc_id", "text", "part", "ghost").union(ghosts)
    return every.withColumn("part", table(dict(enumerate(keys))).cast("int"))


SCHEMA = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_versions(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document.

    ``docs`` needs doc_id and text; other columns are ignored. Null texts count as empty. Documents follow
    each other by descending doc_id, null last, repeated ones by descending text; after the last comes the
    first. A single document follows itself. Whole texts are read; two texts without a paragraph are alike.
    An empty table gives no rows.
    """
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = with_next(docs).repartition(n, "part").sortWithinPartitions("part", F.desc("ghost"), F.col("doc_id").asc_nulls_first(), "text")

    def run(batches):
        part, after, after_keys = None, "", np.empty(0, np.uint64)
        for batch in batches:
            for block in common.blocks(batch):
                rows, keys, edits, edit_keys, nexts = [], [], [], [], []
                for doc_id, text, of, ghost in zip(*(block.column(c).to_pylist() for c in ("doc_id", "text", "part", "ghost")), strict=True):
                    own = digests(text)
                    if of != part and not ghost:
                        raise RuntimeError("a range without the document before it")
                    if not ghost:
                        edit = edited(text, after)
                        rows.append((doc_id, len(text), hashlib.sha256(edit.encode("utf-8", "surrogatepass")).hexdigest()))
                        keys.append(own)
                        edits.append(edit)
                        edit_keys.append(digests(edit))
                        nexts.append(after_keys)
                    part, after, after_keys = of, text, own
                first = zip(*rows, strict=True) if rows else ([], [], [])
                yield common.record(SCHEMA, *first, written(keys), written(edit_keys), likeness(keys, edit_keys), likeness(keys, nexts))

    return dealt.mapInArrow(run, DDL)
