"""Ranked lexical search by MaxScore, shard by shard.

A pass over all texts keeps, of each document, its length and how often it holds the items' terms; from that
come the statistics of the whole corpus. Then every task takes its documents, shard by shard, as posting lists
with the largest score that each list can give, and answers all items: lists are taken from the largest bound
down, and once what the rest can give together is less than the score that is needed, they are not essential: no
document enters by them, and they are probed only for documents that can still qualify. Scores needed are carried
from shard to shard, so later ones do less. A task gives the best of each item; those are ranked together.

Items are dealt into blocks whose different terms have a bound, and each block is one search over all documents, so
what is sent to the tasks has that bound, however many items there are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from commitloom import scratch
from commitloom.llm.common import blocks, record

#: Pairs of item and term that one block of items has, about: what is sent to every task.
BLOCK_TERMS = 200_000
#: Postings of a shard, about (one document at least).
SHARD = 2_000_000
#: Fixed values of the score: the share of length in m, in hundredths, and the scales of tf and weights.
LENGTH, SCALE, WEIGHT = 25, 1_000, 1_000

#: A-Z to a-z; digits, letters and all bytes of other characters stay, the rest parts terms.
_BYTES = bytes(x + 32 if 65 <= x <= 90 else x if 48 <= x <= 57 or 97 <= x <= 122 or x >= 128 else 32 for x in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a text in UTF-8, in order."""
    return text.translate(_BYTES).split()


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term, times of every item; rows of equal item_id are one item, and rows without it are none."""

    def run(batches):
        for batch in batches:
            ids, terms, times = [], [], []
            for i, text in zip(batch.column("item_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                for term, n in Counter(terms_of(text or b"")).items():
                    ids.append(i)
                    terms.append(term)
                    times.append(n)
            yield record([("item_id", pa.int64()), ("term", pa.binary()), ("times", pa.int64())], ids, terms, times)

    found = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long"), "text").mapInArrow(run, "item_id long, term binary, times long")
    return found.groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def dealt(terms: DataFrame, most: int = BLOCK_TERMS) -> Iterator[dict[int, list[tuple[bytes, int]]]]:
    """Blocks of whole items with about ``most`` pairs of item and term; the driver holds one at a time."""
    block, n = {}, 0
    for r in terms.orderBy("item_id", "term").toLocalIterator():
        if n >= most and r.item_id not in block:
            yield block
            block, n = {}, 0
        block.setdefault(r.item_id, []).append((bytes(r.term), r.times))
        n += 1
    if block:
        yield block


def counted(docs: DataFrame, place: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms, with repeats), at, tf: of each document with a term, which of ``place``'s terms it holds and how often."""
    sent = docs.sparkSession.sparkContext.broadcast(place)
    schema = [("doc_id", pa.int64()), ("n", pa.int64()), ("at", pa.list_(pa.int32())), ("tf", pa.list_(pa.int64()))]

    def run(batches):
        place = sent.value
        for batch in batches:
            for block in blocks(batch):
                ids, ns, ats, tfs = [], [], [], []
                for i, text in zip(block.column("doc_id").to_pylist(), block.column("text").cast(pa.binary()).to_pylist(), strict=True):
                    terms = terms_of(text or b"")
                    if terms:
                        known = [(place[t], c) for t, c in Counter(terms).items() if t in place]
                        ids.append(i)
                        ns.append(len(terms))
                        ats.append([a for a, _ in known])
                        tfs.append([c for _, c in known])
                yield record(schema, ids, ns, ats, tfs)

    return docs.mapInArrow(run, "doc_id long, n long, at array<int>, tf array<long>")


class Lists:
    """Posting lists of a shard: for each term the places of its documents, ascending, and what each gives for one unit of weight."""

    def __init__(self, at: np.ndarray, doc: np.ndarray, gives: np.ndarray, terms: int):
        order = np.lexsort((doc, at))
        self.doc, self.gives = doc[order], gives[order]
        self.starts = np.searchsorted(at[order], np.arange(terms + 1))
        self.most = np.zeros(terms, np.int64)
        some = np.flatnonzero(np.diff(self.starts))
        if len(some):
            self.most[some] = np.maximum.reduceat(self.gives, self.starts[some])

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.starts[term], self.starts[term + 1])
        return self.doc[part], self.gives[part]


def kth(scores: np.ndarray, k: int) -> int:
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


def best(lists: Lists, n_docs: int, terms: np.ndarray, weights: np.ndarray, k: int, needed: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(documents, scores, postings read) of a shard that can be among the k best of an item and score ``needed`` at least, ties included.

    ``weights`` are the terms' own times how often the item has them.
    """
    bounds = weights * lists.most[terms]
    order = np.argsort(-bounds, kind="stable")
    order = order[bounds[order] > 0]
    terms, weights, bounds = terms[order], weights[order], bounds[order]
    rest = np.append(np.cumsum(bounds[::-1])[::-1], 0)  # what the lists from here on can give together
    total, read, i = np.zeros(n_docs, np.int64), 0, 0
    while i < len(terms) and rest[i] >= needed:  # essential lists
        doc, gives = lists.of(terms[i])
        total[doc] += weights[i] * gives
        read += len(doc)
        i += 1
        # the k best scores so far are least scores of k documents; looked at when lists have doubled and at likely ends
        if i < len(terms) and (i & (i - 1) == 0 or i % 8 == 0):
            needed = max(needed, kth(total, k))
    open_ = np.flatnonzero(total)
    score = total[open_]
    for j in range(i, len(terms)):  # the others
        needed = max(needed, kth(score, k))
        stay = score + rest[j] >= needed
        open_, score = open_[stay], score[stay]
        if not len(open_):
            break
        doc, gives = lists.of(terms[j])
        if len(open_) * 16 < len(doc):
            where = np.minimum(np.searchsorted(doc, open_), len(doc) - 1)
            hit = doc[where] == open_
            score = score + np.where(hit, weights[j] * gives[where], 0)
            read += len(open_)
        else:
            row = np.zeros(n_docs, np.int64)
            row[doc] = gives
            score = score + weights[j] * row[open_]
            read += len(doc)
    keep = score >= max(needed, kth(score, k), 1)
    return open_[keep], score[keep], read


def _weights(df: dict[int, int], terms: int, n: int) -> np.ndarray:
    held = np.array([df.get(t, 0) for t in range(terms)], float)
    return np.floor(WEIGHT * np.log((2 * n + 2) / (2 * held + 1))).astype(np.int64)


def _answers(batches, items: list[tuple[int, np.ndarray, np.ndarray]], weights: np.ndarray, n: int, length: int, k: int, shard: int):
    """item_id, doc_id, score of the k best documents of a task for each item."""
    kept = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in items]
    held, size = [], 0

    def answer():
        sizes = np.concatenate([np.diff(x[2]) for x in held])
        doc = np.repeat(np.arange(len(sizes)), sizes)
        ids = np.concatenate([x[0] for x in held])
        m = 100 - LENGTH + LENGTH * np.concatenate([x[1] for x in held]) * n // length
        tf = np.concatenate([x[4] for x in held])
        gives = 1_000_000 * SCALE * tf // (SCALE * tf + 12 * m[doc])
        lists = Lists(np.concatenate([x[3] for x in held]), doc, gives, len(weights))
        for i, (_, terms, times) in enumerate(items):
            had_ids, had = kept[i]
            needed = int(had[-1]) if len(had) >= k else 1
            found, score, _ = best(lists, len(sizes), terms, times * weights[terms], k, needed)
            if len(found):
                every, scores = np.concatenate([had_ids, ids[found]]), np.concatenate([had, score])
                order = np.lexsort((every, -scores))[:k]
                kept[i] = every[order], scores[order]

    for batch in batches:
        for at in range(0, len(batch), 4_096):
            part = batch.slice(at, 4_096)
            flat = lambda c: part.column(c).flatten().to_numpy(zero_copy_only=False)  # noqa: E731, B023
            ends = np.append(0, np.cumsum(part.column("at").value_lengths().to_numpy(zero_copy_only=False)))
            held.append((part.column("doc_id").to_numpy(), part.column("n").to_numpy(), ends, flat("at"), flat("tf")))
            size += int(ends[-1])
            if size >= shard:
                answer()
                held, size = [], 0
    if held:
        answer()
    for (item, _, _), (ids, scores) in zip(items, kept, strict=True):
        yield record([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())], np.full(len(ids), item), ids, scores)


def _search_block(docs: DataFrame, block: dict[int, list[tuple[bytes, int]]], k: int, shard: int) -> tuple[DataFrame, str] | None:
    """The best documents of each task for each item of a block, written."""
    spark = docs.sparkSession
    place = {t: i for i, t in enumerate(sorted({t for terms in block.values() for t, _ in terms}))}
    postings, path = scratch.keep(counted(docs, place))
    n, length = postings.agg(F.count("*"), F.sum("n")).first()
    if not n:
        scratch.drop(spark, path)
        return None
    # at most as many rows as a block has terms
    df = {r["at"]: r["df"] for r in postings.select(F.explode("at").alias("at")).groupBy("at").agg(F.count("*").alias("df")).toLocalIterator()}
    items = [(i, np.array([place[t] for t, _ in terms]), np.array([c for _, c in terms], np.int64)) for i, terms in block.items()]
    sent = spark.sparkContext.broadcast((items, _weights(df, len(place), n)))

    def run(batches):
        yield from _answers(batches, *sent.value, n, length, k, shard)

    found = scratch.keep(postings.mapInArrow(run, "item_id long, doc_id long, score long"))
    scratch.drop(spark, path)
    return found


def search(docs: DataFrame, items: DataFrame, k: int = 20, block_terms: int = BLOCK_TERMS, shard: int = SHARD) -> DataFrame:
    """item_id, rank, doc_id, score: for each item the k documents of the highest scores above 0, ties to the smaller doc_id.

    ``docs`` needs doc_id and text, ``items`` item_id and text; other columns are ignored. Rows without doc_id
    are no documents, rows without item_id no items. Null and empty texts have no terms: such documents are
    not counted, and such items find nothing. Repeated rows are documents of their own, so a doc_id may be
    found as often as it has rows; rows of one item_id are one item. Empty tables give no rows.
    """
    spark: SparkSession = docs.sparkSession
    docs = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    terms, path = scratch.keep(item_terms(items))
    found = [x for block in dealt(terms, block_terms) if (x := _search_block(docs, block, k, shard))]
    scratch.drop(spark, path)
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    rows = spark.read.schema(found[0][0].schema).parquet(*[p for _, p in found])
    # a task's best first, so that an item's group has k rows for each of so many parts
    order = [F.desc("score"), "doc_id"]
    part = F.pmod(F.xxhash64("doc_id"), F.lit(64))
    some = rows.withColumn("_part", part).withColumn("_rank", F.row_number().over(Window.partitionBy("item_id", "_part").orderBy(*order))).where(F.col("_rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


#: The same by SQL: every document's score for every item.
SQL = r"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM documents),
i AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM benchmark),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
totals AS (SELECT count(*) AS nn, sum(n)::BIGINT AS l FROM n),
m AS (SELECT doc_id, 100 - 25 + ((25 * n * nn) // l) AS m FROM n, totals),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY doc_id, term),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, totals GROUP BY term, nn),
q AS (SELECT item_id, term, count(*) AS c FROM i GROUP BY item_id, term),
s AS (SELECT item_id, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 20
"""
