"""Sparse features of diffs: TF-IDF, binary counts of path parts and extensions, similarity, scaled numbers."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commitloom.functions import diff_features as D
from commitloom.functions import text as T
from commitloom.schema import MAX_DIFF

#: Largest vocabularies, and the four numbers in order.
MAX_TERMS, MAX_PATHS, MAX_EXTS = 10_000, 2_000, 100
NUMBERS = ["files_changed", "additions", "deletions", "add_del_ratio"]


@dataclass
class Spec:
    """Fitted vocabularies (terms in order of their places), and what scales the numbers."""

    terms: list[str]
    idf: list[float]
    paths: list[str]
    exts: list[str]
    mean: list[float]
    scale: list[float]
    sublinear: bool = False
    norm: str | None = "l2"
    layout: dict[str, list[int]] = field(init=False)

    def __post_init__(self):
        at, self.layout = 0, {}
        for name, n in (("tfidf", len(self.terms)), ("path", len(self.paths)), ("ext", len(self.exts)), ("jaccard", 1), ("numeric", len(NUMBERS))):
            self.layout[name] = [at, at + n]
            at += n

    @property
    def width(self) -> int:
        return self.layout["numeric"][1]


def inputs(rows: DataFrame, max_diff: int = MAX_DIFF) -> DataFrame:
    """``rows`` with null diffs empty and long ones cut, the four numbers as doubles, none being 0."""
    have = [c for c in NUMBERS[:3] if c in rows.columns]
    numbers = {c: D.number(F.col(c)) if c in have else F.lit(0.0) for c in NUMBERS[:3]}
    out = rows.withColumn("diff_text", T.truncate(F.coalesce("diff_text", F.lit("")), max_diff)).withColumns(numbers)
    return out.withColumn("add_del_ratio", D.add_del_ratio(F.col("additions"), F.col("deletions")))


def vocabulary(docs: DataFrame, tokens: Column, size: int, stop_words: list[str] = ()) -> DataFrame:
    """term, tf, df, idf, idx of the ``size`` most frequent terms, ties in order of the term; idx follows the terms' order.

    idf is ln((1 + n) / (1 + df)) + 1. Each document counts its terms in its row, once for both sums, so a term
    that all documents share is summed from partial counts.
    """
    each = docs.select(F.inline(T.counted(tokens)))
    if stop_words:
        each = each.join(F.broadcast(docs.sparkSession.createDataFrame([(w,) for w in stop_words], "term string")), "term", "left_anti")
    most = each.groupBy("term").agg(F.sum("n").alias("tf"), F.count("*").alias("df")).orderBy(F.desc("tf"), "term").limit(size)
    n = docs.agg(F.count("*").alias("n"))
    order = Window.orderBy("term")
    return most.crossJoin(F.broadcast(n)).select(
        "term", "tf", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"), (F.row_number().over(order) - 1).alias("idx")
    )


def tfidf(docs: DataFrame, key: str, tokens: Column, vocab: DataFrame, sublinear: bool = False, norm: str | None = "l2") -> DataFrame:
    """key, idx, value of each document's terms. ``vocab`` (term, idf, idx) is bounded by its size and broadcast; unknown terms are dropped.

    Each document counts its terms in its row, and only its different ones in the vocabulary are dealt by key, for
    the norm, which adds them in the order of idx: the same rows have the same values to the last bit, however they
    came. ``key`` tells documents apart.
    """
    words = docs.select(F.col(key), F.inline(T.counted(tokens))).join(F.broadcast(vocab.select("term", "idf", "idx")), "term")
    tf = F.col("n").cast("double")
    weighted = words.select(key, "idx", ((F.log(tf) + 1 if sublinear else tf) * F.col("idf")).alias("value"))
    if norm != "l2":
        return weighted
    # a fixed number of parts: parts put together by their size before they are read would be as large as memory allows
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    weighted = weighted.repartition(parts, key)
    whole = Window.partitionBy(key).orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    length = F.sqrt(F.sum(F.col("value") * F.col("value")).over(whole))
    return weighted.select(key, "idx", F.when(length > 0, F.col("value") / length).otherwise(F.col("value")).alias("value"))


def binary_counts(docs: DataFrame, key: str, tokens: Column, vocab: DataFrame) -> DataFrame:
    """key, idx, 1.0 of each term of a document that the vocabulary has."""
    words = docs.select(F.col(key), F.explode(F.array_distinct(tokens)).alias("term")).join(F.broadcast(vocab.select("term", "idx")), "term")
    return words.select(key, "idx", F.lit(1.0).alias("value"))


def scaler(rows: DataFrame, columns: list[str] = NUMBERS) -> DataFrame:
    """name, mean, scale of the columns: population deviation, 1 where that is 0."""
    made = rows.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    one = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"m_{c}").alias("mean"), F.coalesce(F.nullif(F.col(f"s_{c}"), F.lit(0.0)), F.lit(1.0)).alias("scale")) for c in columns]))
    return made.select(one.alias("x")).select("x.*")


def _path_words(diff: Column) -> Column:
    """What a vectorizer makes of the joined path parts: it splits them again at what is no word character."""
    return D.tokens(F.array_join(D.path_tokens(diff), " "))


def _ext_words(diff: Column) -> Column:
    return D.tokens(F.array_join(D.extensions(diff), " "))


def fit(rows: DataFrame, stop_words: list[str] | None = None, max_terms: int = MAX_TERMS, max_paths: int = MAX_PATHS, max_exts: int = MAX_EXTS) -> Spec:
    """A spec of ``inputs(rows)``. Vocabularies, bounded by their sizes, reach the driver."""
    stop = StopWordsRemover.loadDefaultStopWords("english") if stop_words is None else stop_words
    diff = F.col("diff_text")
    of = lambda tokens, n, s=(): [(r.term, r.idf) for r in vocabulary(rows, tokens, n, s).orderBy("idx").collect()]
    terms, paths, exts = of(D.tokens(diff), max_terms, stop), of(_path_words(diff), max_paths), of(_ext_words(diff), max_exts)
    scales = {r["name"]: r for r in scaler(rows).collect()}
    return Spec([t for t, _ in terms], [i for _, i in terms], [t for t, _ in paths], [t for t, _ in exts], [scales[c]["mean"] or 0.0 for c in NUMBERS], [scales[c]["scale"] for c in NUMBERS])


def transform(rows: DataFrame, spec: Spec, key: str = "seq") -> DataFrame:
    """key, indices, values of every row: all features in the spec's layout, zeros left out."""
    spark, diff = rows.sparkSession, F.col("diff_text")
    frame = lambda words, idf=None: spark.createDataFrame([(w, i, idf[i] if idf else 1.0) for i, w in enumerate(words)], "term string, idx int, idf double")
    at = {k: v[0] for k, v in spec.layout.items()}
    shift = lambda df, name: df.select(key, (F.col("idx") + at[name]).alias("idx"), "value")
    parts = shift(tfidf(rows, key, D.tokens(diff), frame(spec.terms, spec.idf), spec.sublinear, spec.norm), "tfidf")
    parts = parts.union(shift(binary_counts(rows, key, _path_words(diff), frame(spec.paths)), "path"))
    parts = parts.union(shift(binary_counts(rows, key, _ext_words(diff), frame(spec.exts)), "ext"))
    numbers = [F.struct(F.lit(at["numeric"] + i).alias("idx"), ((F.col(c) - spec.mean[i]) / spec.scale[i]).alias("value")) for i, c in enumerate(NUMBERS)]
    dense = F.explode(F.array(F.struct(F.lit(at["jaccard"]).alias("idx"), D.change_jaccard(diff).alias("value")), *numbers))
    parts = parts.union(rows.select(key, dense.alias("x")).select(key, "x.idx", "x.value"))
    rows_of = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("x"))
    return rows_of.select(key, F.transform("x", lambda x: x["idx"]).alias("indices"), F.transform("x", lambda x: x["value"]).alias("values"))
