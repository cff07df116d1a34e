"""Spelling variants: words one code point apart, grouped without making pairs.

Words that differ by a replacement share a wildcard group: a place, and what stands before and after it. Its
size tells each member how many others there are, and its two most frequent words which other is the best.
Words that differ by an inserted or deleted code point meet where the longer one, without one of its code
points, is the shorter one. A group has at most one word for each code point of the alphabet at its place (each
of so many places, for deletions), so its sort is small whatever the vocabulary's size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commitloom import scratch

#: What a word is made of; code points and occurrences that it has at least.
RUN, LEAST_CHARS, LEAST_COUNT = "[A-Za-zÀ-ÿ]+", 5, 3
#: A word's form occurs at least so many times as often.
RATIO = 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def without(word: Column, at: Column) -> Column:
    """``word`` without its code point ``at`` (from 0)."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))


def slips(doc_id: Column, run: Column, every: int) -> Column:
    """``run`` with one code point gone where ``every`` divides the hash of document and run: slips that are the same on every run.

    Without a doc_id nothing goes.
    """
    h = F.crc32(F.concat(doc_id.cast("string"), F.lit(":"), run))
    return F.when(h % every == 0, without(run, (h % F.length(run)).cast("int"))).otherwise(run)


def vocabulary(docs: DataFrame, every: int | None = None, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n of the runs of ``RUN`` in whole texts (A-Z lower-cased) that are long and frequent enough.

    Null texts have none. Occurrences are summed before the shuffle, so a word that is a third of all costs a
    row a task. ``every``: see ``slips``.
    """
    runs = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN), F.lit(0))
    words = docs.select("doc_id", F.explode(runs).alias("run"))
    words = words.select((slips(F.col("doc_id"), F.col("run"), every) if every else F.col("run")).alias("word"))
    return words.where(F.length("word") >= least_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _keys(word: Column) -> Column:
    """Where a word meets others: (place, before, after) with places from 0; place -1 holds words, itself first, and what deletions make of it."""
    places = F.sequence(F.lit(0), F.length(word) - 1)
    wild = F.transform(places, lambda i: F.struct(i.alias("place"), F.substring(word, F.lit(1), i).alias("before"), F.substring(word, i + 2, F.length(word)).alias("after"), F.lit(False).alias("own")))
    shorter = F.array_distinct(F.transform(places, lambda i: without(word, i)))
    plain = lambda x, own: F.struct(F.lit(-1).alias("place"), x.alias("before"), F.lit("").alias("after"), F.lit(own).alias("own"))
    return F.concat(F.array(plain(word, True)), F.transform(shorter, lambda x: plain(x, False)), wild)


def near(vocab: DataFrame) -> DataFrame:
    """word, n, n_near, best (its near word of largest n, ties to the smallest; null without any), best_n of different words.

    One shuffle by group and one by word. Two words share at most one wildcard group, or else one is what one
    deletion makes of the other, so each near word is counted once.
    """
    rows = vocab.select("word", "n", F.explode(_keys(F.col("word"))).alias("k")).select("word", "n", "k.*")
    group = Window.partitionBy("place", "before", "after")
    # the word itself comes last, after those that become it
    ranked = group.orderBy("own", F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    other = F.struct(F.col("n").alias("n"), F.col("word").alias("word"))
    rows = rows.select(
        "word", "n", "place", "own",
        F.count("*").over(group).alias("size"),
        F.first(other).over(ranked).alias("first"),
        F.nth_value(other, 2).over(ranked).alias("second"),
        F.max(F.when(F.col("own"), other)).over(group).alias("shorter"),
    )
    second = F.when(F.col("first.word") == F.col("word"), F.col("second")).otherwise(F.col("first"))
    others = F.when((F.col("place") >= 0) | F.col("own"), F.col("size") - 1).otherwise(F.when(F.col("shorter").isNotNull(), 1).otherwise(0))
    best = F.when(F.col("place") >= 0, second).when(F.col("own"), F.when(F.col("size") > 1, F.col("first"))).otherwise(F.col("shorter"))
    found = rows.select("word", "n", others.cast("long").alias("others"), F.when(best.isNotNull(), F.struct((-best["n"]).alias("less"), best["word"].alias("word"))).alias("best"))
    return found.groupBy("word").agg(F.max("n").alias("n"), F.sum("others").alias("n_near"), F.min("best").alias("best")).select(
        "word", "n", "n_near", F.col("best.word").alias("best"), (-F.col("best.less")).alias("best_n")
    )


def with_roots(forms: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``forms`` (word, n, form and others) with root: the last of a word's form, that one's form, and so on.

    Each step multiplies n by ``ratio`` at least, so paths are short; every round doubles how far they are known.
    """
    most = forms.agg(F.max("n")).first()[0] or 1
    links, path = scratch.keep(forms.where("form is not null").select("word", F.col("form").alias("root")))
    steps = 1
    while ratio**steps <= most:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        further, now = scratch.keep(links.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root")))
        scratch.drop(forms.sparkSession, path)
        links, path, steps = further, now, 2 * steps
    return forms.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, every: int | None = None, ratio: int = RATIO, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``docs`` (doc_id, text; other columns are ignored).

    A word's form is its most frequent near word (ties: the smallest in code-point order), if that occurs
    ``ratio`` times as often at least, else null; root is where forms lead to, the word itself without any.
    Null and empty texts have no words, repeated rows count again, an empty table gives no rows; rows without
    doc_id count without slips.
    """
    vocab, _ = scratch.keep(vocabulary(docs, every, least_chars, least_count))
    takes = F.col("best_n") >= ratio * F.col("n")
    forms, _ = scratch.keep(near(vocab).select("word", "n", "n_near", F.when(takes, F.col("best")).alias("form"), F.when(takes, F.col("best_n")).alias("form_n")))
    return with_roots(forms, ratio).select("word", "form", "root", "n", "n_near", "form_n")
