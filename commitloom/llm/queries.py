"""The queries of this subpackage, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commitloom.llm import ann, bpe, chat, fingerprint, langid, lexical, mainhtml, ngram_join, packing, secrets, spelling, toxicity, urlfilter
from commitloom.llm.common import table

#: Fixed values of the URL query.
URL_RULES = [
    urlfilter.Rule("block", "com", "/en/"),
    urlfilter.Rule("allow", "example.com", "/en/7"),
    urlfilter.Rule("allow", "net", "/de/"),
    urlfilter.Rule("block", "example.net", "/de/8"),
    urlfilter.Rule("block", "org", "/es/"),
]
#: Hosts of the corpus that have one of these words are the listed keys of the URL query.
LISTED_WORDS = ["adult", "ads-track", "bets", "casino", "pills", "spam"]


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host = urlfilter.host_of(F.col("url"))
    listed = pages.select(host.alias("key")).where(F.col("key").rlike("|".join(LISTED_WORDS))).distinct()
    return urlfilter.filter_urls(pages, URL_RULES, listed)


OP10_SQL = """
WITH parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(action, rhost, rpath) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
  ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
fits AS (
  SELECT page_id, host, path, rhost || rpath AS rule, action,
    row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rhost || rpath) DESC) AS k
  FROM (SELECT DISTINCT * FROM parts) p JOIN rules
    ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT p.page_id, p.host, p.path, f.rule,
  coalesce(f.action, CASE WHEN regexp_matches(p.host, 'adult|ads-track|bets|casino|pills|spam') THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p LEFT JOIN fits f ON f.k = 1 AND f.page_id = p.page_id AND f.host = p.host AND f.path = p.path
"""


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


OP6_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS position
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, count(*) AS n_turns, list({'r': role, 't': text} ORDER BY position) AS turns,
    string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY position) AS rendered
  FROM t GROUP BY conv_id),
whole AS (SELECT min(conv_id) AS conv_id, n_turns, turns, any_value(rendered) AS rendered FROM c GROUP BY n_turns, turns),
inner_prefixes AS (SELECT DISTINCT turns[:k] AS turns FROM (SELECT turns, unnest(range(1, n_turns)) AS k FROM whole))
SELECT conv_id, n_turns, rendered FROM whole WHERE turns NOT IN (SELECT turns FROM inner_prefixes)
"""

def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.model_of(docs))
    spans = F.col("spans")
    base = F.filter(spans, lambda x: x["kind"] != "markov")
    count = lambda kind: F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(kind).alias(f"n_{kind}") for kind, *_ in secrets.BASE],
        F.sha2(secrets.written(base), 256).alias("base_sha256"), secrets.written(spans).alias("spans"),
    )


def in_part(parts: int, held: int):
    """Whether a row's doc_id falls in the part ``held`` of ``parts``; false for null."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(parts)) == held, F.lit(False))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~in_part(4, 2)))
    held = docs.select("doc_id", "text", in_part(4, 2).alias("held_out"))
    return langid.identify(held, model).select("doc_id", "held_out", "lang_pred", "score")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~in_part(5, 0)))
    held = docs.select("doc_id", "text", in_part(5, 0).alias("held_out"))
    return toxicity.score(held, model).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_versions(table(spark, sf_dir, "documents"))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(table(spark, sf_dir, "documents"), width=4, percent=85)


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mainhtml.extract(table(spark, sf_dir, "pages"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), every=97)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_ngram_join": op1_ngram_join,
    "op2_nearest_neighbours": op2_nearest_neighbours,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op6_chat_formatting": op6_chat_formatting,
    "op4_language_id": op4_language_id,
    "op5_fingerprints": op5_fingerprints,
    "op7_bpe": op7_bpe,
    "op8_secret_scans": op8_secret_scans,
    "op9_toxicity": op9_toxicity,
    "op10_url_filters": op10_url_filters,
    "op11_html_extraction": op11_html_extraction,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_lexical_search": op13_lexical_search,
}
ORACLES = {"op6_chat_formatting": OP6_SQL, "op10_url_filters": OP10_SQL, "op13_lexical_search": lexical.SQL}
