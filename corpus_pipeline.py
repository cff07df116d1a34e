"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last
return the columns of ``documents``. An empty table passes through all stages as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commitloom import scratch
from commitloom.llm import langid, ngram_join, packing, secrets, toxicity
from commitloom.llm.common import table

#: Near duplicates: words of a shingle, and similarity in hundredths.
WIDTH, PERCENT = 5, 80
#: Documents of at least this toxicity go.
TOXIC = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in known languages, one or several; texts that are null, have no letter, or fit no language well go.

    Repeated rows stay or go together. Without labelled rows no language is known and all go.
    """
    found = langid.identify(docs, langid.fit(docs), fit=True)
    known = (F.col("score") >= langid.LEAST_SCORE) | (F.col("fit") >= langid.LEAST_FIT)
    return found.where((F.col("lang_pred") != "und") & known).select(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC by a model of the labelled ones among them.

    Null and empty texts have the score of a text without words; repeated rows stay or go together. Without
    labels of both kinds every document has the same score, the share of toxic labels (0.01 without any).
    """
    found = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return found.where(F.col("score") < TOXIC).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id; rows of equal doc_id stay or go together.

    Null and empty texts, and ones without words, link with nothing and stay, as do rows without doc_id.
    """
    groups = ngram_join.link(docs, WIDTH, PERCENT)
    gone, _ = scratch.keep(groups.where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct())
    return ngram_join.without(docs, "doc_id", gone)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced by a mark and n_chars counted again.

    Null texts become empty ones of 0 characters. Repeated rows give repeated results.
    """
    found = secrets.scan_columns(docs, secrets.model_of(docs))
    clean = secrets.redact(F.col("text"), F.col("spans"))
    return found.withColumn("text", clean).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's tokens stand in which training sequence.

    Null and empty texts are their end token alone; repeated rows are documents of their own.
    """
    return packing.pack(docs)


STAGES = [
    ("language_id", language_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

#: Trained models, tokenizers and bin packing are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; a stage's table goes once the next one's is written. No rows give no rows."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs, path = scratch.keep(stage(spark, docs, sf_dir))
        if before:
            scratch.drop(spark, before)
        before = path
    return docs
