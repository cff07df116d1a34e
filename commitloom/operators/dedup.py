"""De-duplication in first-seen order: by (repo, sha), by normalized diff, and by SimHash.

Rows carry ``seq``, their place in a total order; the smallest of equal ones stays.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commitloom import scratch
from commitloom.functions import text as T
from commitloom.operators.graph import components

#: Tokens of a shingle, characters that stand for a text without tokens, bits of a signature.
SHINGLE, HEAD, BITS = 5, 32, 64
#: Edges of a group of near rows that one task walks through, at most.
GROUP_EDGES = 1_000_000
#: Signatures of a bucket that are compared with so many others in one go, at most, about.
BUCKET = 4_096
#: Line numbers of a row of a report in pieces, about.
PIECE = 100_000


def _first(df: DataFrame, keys: list[str]) -> DataFrame:
    """One (keys, seq) row for each key: a partial aggregate runs before the shuffle, so hot keys cost one row a task."""
    return df.groupBy(*keys).agg(F.min("seq").alias("seq"))


def with_drop_reason(commits: DataFrame) -> DataFrame:
    """``commits`` (seq, repo, sha, diff_text and others) with norm_md5 and drop_reason: ``sha``, ``diff`` or null.

    A row whose (repo, sha) was seen goes; blank shas are exempt. Then a row without a normalized diff goes,
    and one whose normalized diff was seen among those that passed: a row that goes here has claimed its
    sha all the same. Only keys, not diffs, are shuffled to find the first ones.
    """
    keys, _ = scratch.keep(keys_of(commits))
    return commits.join(reasons(keys), "seq", "left")


def keys_of(commits: DataFrame) -> DataFrame:
    """seq, _repo, _sha and norm_md5 (null for an empty normalized diff) of ``commits``."""
    sha, repo = T.strip(F.coalesce("sha", F.lit(""))), T.strip(F.coalesce("repo", F.lit("")))
    norm_md5 = T.let(T.normalize_diff(F.coalesce("diff_text", F.lit(""))), lambda norm: F.when(norm != "", F.md5(norm)))
    return commits.select("seq", repo.alias("_repo"), sha.alias("_sha"), norm_md5.alias("norm_md5"))


def reasons(keys: DataFrame, known_shas: DataFrame | None = None, known_diffs: DataFrame | None = None) -> DataFrame:
    """seq, norm_md5, drop_reason of rows of ``keys_of``; shas (_repo, _sha) and diffs (norm_md5) that are known count as seen before."""
    blank = F.col("_sha") == ""
    firsts = keys.where(~blank).groupBy("_repo", "_sha").agg(F.min_by(F.struct("seq", "norm_md5"), "seq").alias("x"))
    if known_shas is not None:
        firsts = firsts.join(known_shas, ["_repo", "_sha"], "left_anti")
    passed = keys.where(blank).select("seq", "norm_md5").union(firsts.select("x.seq", "x.norm_md5"))
    kept = _first(passed.where(F.col("norm_md5").isNotNull()), ["norm_md5"])
    if known_diffs is not None:
        kept = kept.join(known_diffs, "norm_md5", "left_anti")
    marks = passed.select("seq", F.lit(1).alias("m")).union(kept.select("seq", F.lit(2).alias("m"))).groupBy("seq").agg(F.max("m").alias("_m"))
    reason = F.when(F.col("_m").isNull(), "sha").when(F.col("_m") == 1, "diff")
    return keys.select("seq", "norm_md5").join(marks, "seq", "left").select("seq", "norm_md5", reason.alias("drop_reason"))


def shingles(tokens: Column) -> Column:
    """Runs of SHINGLE tokens, as often as they occur; with fewer tokens the tokens."""

    def runs(t):
        many = F.transform(F.sequence(F.lit(1), F.size(t) - (SHINGLE - 1)), lambda i: F.array_join(F.slice(t, i, SHINGLE), " "))
        return F.when(F.size(t) >= SHINGLE, many).otherwise(t)

    return T.let(tokens, runs)


_WORD = re.compile(r"\w+")


def simhash(text: str) -> int:
    """64 votes of the shingles' MD5 digests (first eight bytes, big-endian), a tie being 0; as a signed number."""
    words = _WORD.findall(text.lower())
    parts = [" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)] if len(words) >= SHINGLE else words or [text[:HEAD]]
    digests = b"".join([hashlib.md5(p.encode("utf-8", "replace")).digest()[:8] for p in parts])
    votes, step = np.zeros(BITS, np.int64), 8 * 65_536
    for at in range(0, len(digests), step):
        bits = np.unpackbits(np.frombuffer(digests[at : at + step], np.uint8).reshape(-1, 8), axis=1)
        votes += 2 * bits.sum(axis=0, dtype=np.int64) - len(bits)
    return int.from_bytes(np.packbits(votes > 0).tobytes(), "big", signed=True)


def with_simhash(df: DataFrame, text: str, out: str = "sig") -> DataFrame:
    """``df`` with the signature of a text column, null as empty. Runs over Arrow batches: 64 sums in SQL are far slower.

    Texts leave Arrow one at a time, so a worker's memory is that of a batch and not of all its strings.
    """
    names = [c for c in df.columns if c != out]

    def run(batches):
        for batch in batches:
            sigs = pa.array((simhash(t.as_py() or "") for t in batch.column(text)), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, sigs], names=[*batch.schema.names, out])

    return df.select(*names).mapInArrow(run, df.select(*names).schema.add(out, "long"))


def near_pairs(sigs: DataFrame, threshold: int = 3, bands: int = 4) -> DataFrame:
    """lo, hi, distance: pairs of seqs (lo first) with one of ``bands`` equal bands and at most ``threshold`` differing bits.

    ``sigs`` has seq and different sigs. Sharing a band is part of what a pair is. The other bits are cut into
    one piece more than may differ, so one piece agrees as well; joining on band and piece keeps buckets
    small where a 16-bit band alone would fill with the data. A bucket of more than BUCKET signatures is dealt
    into parts by hashes of seq, and every part meets every part in a tile of its own: a signature is copied as
    often as its bucket has parts, and no tile grows with the bucket.
    """
    if BITS % bands:
        raise ValueError("bands must divide 64")
    width = BITS // bands
    rest, pieces = BITS - width, threshold + 1
    turned = lambda b: F.shiftleft("sig", width * b).bitwiseOR(F.shiftrightunsigned("sig", BITS - width * b)) if b else F.col("sig")
    keys = []
    for b in range(bands):
        for p in range(pieces if rest else 1):
            low, high = rest * p // pieces, rest * (p + 1) // pieces
            piece = F.shiftrightunsigned(F.shiftleft(turned(b), BITS - high), BITS - high + low) if high > low else F.lit(0).cast("long")
            keys.append(F.struct(F.lit(b * pieces + p).alias("place"), F.shiftrightunsigned(turned(b), rest).alias("band"), piece.alias("piece")))
    rows = sigs.select("seq", "sig", F.explode(F.array(*keys)).alias("k")).select("seq", "sig", "k.*")
    bucket = ["place", "band", "piece"]
    large = rows.groupBy(*bucket).agg(F.count("*").alias("n")).where(F.col("n") > BUCKET).select(*bucket, F.ceil(F.col("n") / BUCKET).alias("parts"))
    rows = rows.join(large, bucket, "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("seq"), F.col("parts")))
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    left = rows.select(*bucket, F.col("part").alias("row"), others.alias("column"), F.col("seq").alias("lo"), F.col("sig").alias("a"))
    right = rows.select(*bucket, others.alias("row"), F.col("part").alias("column"), F.col("seq").alias("hi"), F.col("sig").alias("b"))
    distance = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    found = left.join(right, [*bucket, "row", "column"]).where((F.col("lo") < F.col("hi")) & (distance <= threshold))
    return found.select("lo", "hi", distance.alias("distance")).distinct()


def near_duplicates(sigs: DataFrame, threshold: int = 3, bands: int = 4) -> DataFrame:
    """seq of the rows of ``sigs`` (seq, sig) that go, in first-seen order: those near an earlier row that stays.

    Of equal signatures all but the first go at once. The others are walked through in order, each connected
    group of neighbours in one task. Groups of more than GROUP_EDGES edges are settled in rounds instead: a row
    goes once an earlier neighbour stays, and stays once all earlier neighbours go; each round is written. A row
    that goes can't drop another.
    """
    sigs, _ = scratch.keep(sigs.select("seq", "sig"))
    firsts = _first(sigs, ["sig"])
    edges, _ = scratch.keep(near_pairs(firsts, threshold, bands).select("lo", "hi"))
    equal = sigs.join(firsts.select("seq"), "seq", "left_anti").select("seq")
    group = components(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))).select(F.col("node").alias("lo"), "component")
    grouped, _ = scratch.keep(edges.join(group, "lo"))
    large = grouped.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > GROUP_EDGES).select("component")
    large, _ = scratch.keep(large)
    return equal.union(_walked(grouped.join(large, "component", "left_anti"))).union(_in_rounds(grouped.join(large, "component", "left_semi").select("lo", "hi")))


def _walked(edges: DataFrame) -> DataFrame:
    """seq of the rows that go, of whole connected groups (component, lo, hi)."""

    def run(batches):
        now, gone = None, set()
        for batch in batches:
            out = []
            for component, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("component", "lo", "hi")), strict=True):
                if component != now:
                    now, gone = component, set()
                # by hi, so that whether lo goes is known
                if lo not in gone and hi not in gone:
                    gone.add(hi)
                    out.append(hi)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["seq"])

    return edges.repartition("component").sortWithinPartitions("component", "hi", "lo").mapInArrow(run, "seq long")


def _in_rounds(edges: DataFrame) -> DataFrame:
    spark = edges.sparkSession
    edges, _ = scratch.keep(edges)
    out = spark.createDataFrame([], "seq long")
    while edges.limit(1).count():
        # rows that have no open earlier neighbour stay; their later neighbours go
        stay = edges.select(F.col("lo").alias("seq")).distinct().join(edges.select(F.col("hi").alias("seq")).distinct(), "seq", "left_anti")
        stay, _ = scratch.keep(stay)
        drop, _ = scratch.keep(edges.join(stay.withColumnRenamed("seq", "lo"), "lo", "left_semi").select(F.col("hi").alias("seq")).distinct())
        out = out.union(drop)
        settled = stay.union(drop)
        edges, _ = scratch.keep(
            edges.join(settled.withColumnRenamed("seq", "lo"), "lo", "left_anti").join(settled.withColumnRenamed("seq", "hi"), "hi", "left_anti").select("lo", "hi")
        )
    return out


def deduplicate(commits: DataFrame, near: bool = False, hamming: int = 3, bands: int = 4) -> tuple[DataFrame, DataFrame]:
    """(kept rows, drop counters) of the two exact passes, and of the third if ``near``.

    Counters are one row: total, dropped_sha, dropped_diff, dropped_near, kept.
    """
    marked, _ = scratch.keep(with_drop_reason(commits))
    if near:
        kept = with_simhash(marked.where("drop_reason is null").select("seq", T.normalize_diff(F.col("diff_text")).alias("norm")), "norm")
        close = near_duplicates(kept, hamming, bands).select("seq", F.lit("near").alias("_near"))
        marked = marked.join(close, "seq", "left").withColumn("drop_reason", F.coalesce("drop_reason", "_near")).drop("_near")
    counts = marked.agg(
        F.count("*").alias("total"), *[F.count_if(F.col("drop_reason") == r).alias(f"dropped_{r}") for r in ("sha", "diff", "near")], F.count_if(F.col("drop_reason").isNull()).alias("kept")
    )
    return marked.where("drop_reason is null").drop("drop_reason", "norm_md5"), counts


def _values(rows: DataFrame, keys: list[str], line: str) -> DataFrame:
    """key_ord, key, value, _line of all values that are not null."""
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("key_ord"), F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for i, k in enumerate(keys)]))
    return rows.select(F.col(line).alias("_line"), pairs.alias("p")).select("_line", "p.*").where(F.col("value").isNotNull())


def duplicate_counts(rows: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """key_ord, key, value, count of values on two lines at least. Tasks count before the shuffle, so a hot value costs one row a task."""
    return _values(rows, keys, line).groupBy("key_ord", "key", "value").agg(F.count("*").alias("count")).where("count >= 2")


def duplicate_report(rows: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """key, value, count, line_numbers (ascending, joined by ;) of values on two lines at least, and key_ord for the order of the keys.

    A value is one row, however many lines it is on; ``duplicate_pieces`` has rows of a bounded size.
    """
    numbers = F.array_join(F.transform(F.array_sort(F.collect_list("_line")), lambda x: x.cast("string")), ";")
    return _values(rows, keys, line).groupBy("key_ord", "key", "value").agg(F.count("*").alias("count"), numbers.alias("line_numbers")).where("count >= 2")


def duplicate_pieces(rows: DataFrame, keys: list[str], line: str = "line", most: int = PIECE) -> DataFrame:
    """``duplicate_report`` with piece (from 0): a value on many lines has several rows, of about ``most`` numbers each, in ascending order.

    Numbers are gathered by ranges of lines first, so that the lines of a value in every row are spread over
    tasks; ranges are put together into pieces by running sums of their sizes, which alone meet in one task.
    Line numbers differ in a range; a row without one counts and has no number.
    """
    span = F.floor(F.col("_line") / most)
    ranges = _values(rows, keys, line).withColumn("_range", span).groupBy("key_ord", "key", "value", "_range").agg(F.count("*").alias("n"), F.collect_list("_line").alias("lines"))
    ranges, _ = scratch.keep(ranges)
    value = ["key_ord", "key", "value"]
    own = Window.partitionBy(*value)
    sizes = ranges.select(*value, "_range", "n").withColumn("count", F.sum("n").over(own)).where("count >= 2")
    before = F.sum("n").over(own.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    piece = F.floor(F.coalesce(before, F.lit(0)) / most).cast("int")
    places = sizes.select(F.col("key_ord").alias("_key"), F.col("value").alias("_value"), F.col("_range").alias("_place"), "count", piece.alias("piece"))
    same = (F.col("key_ord") == F.col("_key")) & (F.col("value") == F.col("_value")) & F.col("_range").eqNullSafe(F.col("_place"))
    joined = ranges.join(places, same).select(*value, "count", "piece", "lines")
    numbers = F.array_join(F.transform(F.array_sort(F.flatten(F.collect_list("lines"))), lambda x: x.cast("string")), ";")
    return joined.groupBy(*value, "count", "piece").agg(numbers.alias("line_numbers"))


def duplicate_preview(report: DataFrame, n: int = 10) -> DataFrame:
    """The n most frequent values of each key of ``duplicate_counts`` or ``duplicate_report``, and how many more there are."""
    own = Window.partitionBy("key_ord")
    ranked = report.withColumn("rank", F.row_number().over(own.orderBy(F.desc("count"), "value"))).withColumn("more", F.greatest(F.count("*").over(own) - n, F.lit(0)))
    return ranked.where(F.col("rank") <= n)
