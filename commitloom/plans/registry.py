"""Every registered query, by name, and the SQL that must give the same rows."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commitloom import scratch
from commitloom.functions import diff_features as D
from commitloom.functions import rules
from commitloom.functions import text as T
from commitloom.operators import dedup, evaluation, features, incremental, ingest, quotas, scoring, stages, training
from commitloom.plans.commit_view import DUCKDB, commits
from commitloom.schema import LABELS
from commitloom.sources import payload as payloads
from commitloom.sources import records
from commitloom.streaming import dedup as streams

QUERIES, ORACLES = {}, {}

#: The SQL's building blocks over the commit view.
_HEADER = "^(" + "|".join(LABELS) + r")(?:\([^)]+\))?!?:\s[^\n]+"
_LABEL = f"nullif(regexp_extract(message, '{_HEADER}', 1), '')"
_LINES = "string_split(diff_text, chr(10))"
_NORM = rf"array_to_string(list_transform(list_filter({_LINES}, lambda l: not regexp_matches(l, '^(index [0-9a-f]+\.\.[0-9a-f]+.*|@@ .*|commit [0-9a-f]+|Author:.*|Date:.*|\s*)$')), lambda l: regexp_replace(l, '\s+$', '')), chr(10))"
_ADDED = f"list_filter({_LINES}, lambda l: l[1] = '+' and not starts_with(l, '+++'))"
_DELETED = f"list_filter({_LINES}, lambda l: l[1] = '-' and not starts_with(l, '---'))"
_PATHS = r"regexp_extract_all(diff_text, '(?m)^\+\+\+ b/(.+)$', 1)"
_WITH = f"WITH commits AS ({DUCKDB})"
_MARKED = f"""{_WITH}, keyed AS (SELECT *, {_NORM} AS norm, {_LABEL} AS label FROM commits),
a AS (SELECT *, sha = '' OR row_number() OVER (PARTITION BY repo, sha ORDER BY seq) = 1 AS passed FROM keyed),
b AS (SELECT *, row_number() OVER (PARTITION BY passed, norm ORDER BY seq) AS n FROM a),
marked AS (SELECT *, CASE WHEN NOT passed THEN 'sha' WHEN norm = '' OR n > 1 THEN 'diff' END AS drop_reason FROM b)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commits(spark, sf_dir).withColumn("label", T.conventional_label(F.col("message")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# De-duplication, its counters, and reports of duplicates


@query(f"{_MARKED} SELECT label, count(*) AS n_before, count(*) FILTER (WHERE drop_reason IS NULL) AS n_after FROM marked WHERE label IS NOT NULL GROUP BY label")
def dedup_label_histogram(spark, sf_dir):
    marked = dedup.with_drop_reason(labelled(spark, sf_dir))
    return marked.where("label is not null").groupBy("label").agg(F.count("*").alias("n_before"), F.count_if(F.col("drop_reason").isNull()).alias("n_after"))


@query(f"{_MARKED} SELECT seq, md5(norm) AS norm_md5, drop_reason FROM marked")
def dedup_reasons(spark, sf_dir):
    return dedup.with_drop_reason(commits(spark, sf_dir)).select("seq", "norm_md5", "drop_reason")


@query(f"{_MARKED} SELECT seq, md5(norm) AS norm_md5, drop_reason FROM marked")
def incremental_reasons(spark, sf_dir):
    """The same in three batches, each held against the index of keys that those before it left."""
    rows = commits(spark, sf_dir)
    least, most = rows.agg(F.min("seq"), F.max("seq")).first()
    path = f"{scratch.folder(spark)}/seen_{uuid.uuid4().hex}"
    third = F.least(F.floor((F.col("seq") - least) * 3 / max(most - least, 1)), F.lit(2)) if least is not None else F.lit(0)
    out = None
    for i in range(3):
        marked, _ = scratch.keep(incremental.deduplicate_batch(rows.where(third == i), incremental.SeenKeys(spark, path), str(i)).select("seq", "norm_md5", "drop_reason"))
        out = marked if out is None else out.union(marked)
    return out


@query(
    f"{_MARKED} SELECT count(*) AS total, count(*) FILTER (WHERE drop_reason = 'sha') AS dropped_sha, count(*) FILTER (WHERE drop_reason = 'diff') AS dropped_diff, 0::BIGINT AS dropped_near, count(*) FILTER (WHERE drop_reason IS NULL) AS kept FROM marked"
)
def dedup_counters(spark, sf_dir):
    return dedup.deduplicate(commits(spark, sf_dir))[1]


#: The walk in first-seen order over ``placed`` (seq, sig, i from 1): rows near a kept earlier one that shares a 16-bit band go.
_WALK = """walk AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept, []::BIGINT[] AS gone
  UNION ALL SELECT p.i, CASE WHEN near THEN kept ELSE list_append(kept, sig) END, CASE WHEN near THEN list_append(gone, p.seq) ELSE gone END
  FROM (SELECT w.kept, w.gone, p.i, p.seq, p.sig, len(list_filter(w.kept, lambda k: bit_count(xor(k, p.sig)) <= THRESHOLD AND
    (xor(k, p.sig) & 65535 = 0 OR (xor(k, p.sig) >> 16) & 65535 = 0 OR (xor(k, p.sig) >> 32) & 65535 = 0 OR (xor(k, p.sig) >> 48) & 65535 = 0))) > 0 AS near
    FROM walk w JOIN placed p ON p.i = w.i + 1) p),
gone AS (SELECT unnest(gone) AS seq FROM walk WHERE i = (SELECT max(i) FROM placed))"""


def _sig_sql(source: str) -> str:
    """CTEs that end in sigs (seq, sig) of the rows (doc_id, text) of a query."""
    return _SIG.replace("FROM documents)", f"FROM ({source}))")


@query()
def dedup_with_near(spark, sf_dir):
    return dedup.deduplicate(commits(spark, sf_dir), near=True)[0].select("seq", "repo", "sha")


_TOKENS = r"regexp_extract_all(lower(text), '[\pL\pN_]+')"
_SHINGLES = f"SELECT doc_id, text, CASE WHEN len(t) >= 5 THEN list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i+4], ' ')) ELSE t END AS s FROM (SELECT doc_id, text, {_TOKENS} AS t FROM documents)"


@query(f"SELECT doc_id, len(s)::BIGINT AS n_shingles, len(list_distinct(s))::BIGINT AS n_distinct FROM ({_SHINGLES})")
def shingle_counts(spark, sf_dir):
    s = documents(spark, sf_dir).select("doc_id", dedup.shingles(D.tokens(F.col("text"), D.WORD)).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n_shingles"), F.size(F.array_distinct("s")).cast("long").alias("n_distinct"))


_SIG = f"""sh AS (SELECT doc_id, unnest(CASE WHEN len(s) = 0 THEN [substr(text, 1, 32)] ELSE s END) AS s FROM ({_SHINGLES})),
hashes AS (SELECT doc_id, ('0x' || substr(md5(s), 1, 16))::UBIGINT AS h, count(*) AS n FROM sh GROUP BY ALL),
bits AS (SELECT doc_id, b, sum(CASE WHEN (h >> b) & 1 = 1 THEN n ELSE -n END) > 0 AS on_ FROM hashes, range(0, 64) r(b) GROUP BY ALL),
sigs AS (SELECT doc_id AS seq, sum(CASE WHEN NOT on_ THEN 0 WHEN b = 63 THEN -9223372036854775808 ELSE (1::BIGINT << b) END)::BIGINT AS sig FROM bits GROUP BY doc_id)"""


@query(f"WITH {_SIG} SELECT * FROM sigs")
def simhash_signatures(spark, sf_dir):
    return dedup.with_simhash(documents(spark, sf_dir).select(F.col("doc_id").alias("seq"), "text"), "text").select("seq", "sig")


_PAIRS = f"""{_SIG}, firsts AS (SELECT sig, min(seq) AS seq FROM sigs GROUP BY sig),
pairs AS (SELECT a.seq AS lo, b.seq AS hi, bit_count(xor(a.sig, b.sig))::INT AS distance FROM firsts a JOIN firsts b
  ON a.seq < b.seq AND bit_count(xor(a.sig, b.sig)) <= 3)"""


@query(f"WITH {_PAIRS} SELECT * FROM pairs")
def near_pairs(spark, sf_dir):
    sigs = dedup.with_simhash(documents(spark, sf_dir).select(F.col("doc_id").alias("seq"), "text"), "text").select("seq", "sig")
    sigs, _ = scratch.keep(sigs)
    return dedup.near_pairs(sigs.groupBy("sig").agg(F.min("seq").alias("seq")))


@query(
    f"""WITH RECURSIVE {_SIG}, placed AS (SELECT seq, sig, row_number() OVER (ORDER BY seq) AS i FROM sigs),
walk AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept, []::BIGINT[] AS gone
  UNION ALL SELECT p.i, CASE WHEN near THEN kept ELSE list_append(kept, sig) END, CASE WHEN near THEN list_append(gone, p.seq) ELSE gone END
  FROM (SELECT w.kept, w.gone, p.i, p.seq, p.sig, len(list_filter(w.kept, lambda k: bit_count(xor(k, p.sig)) <= 3)) > 0 AS near FROM walk w JOIN placed p ON p.i = w.i + 1) p)
SELECT unnest(gone) AS seq FROM walk WHERE i = (SELECT max(i) FROM placed)"""
)
def near_duplicates(spark, sf_dir):
    sigs = dedup.with_simhash(documents(spark, sf_dir).select(F.col("doc_id").alias("seq"), "text"), "text").select("seq", "sig")
    return dedup.near_duplicates(sigs)


_REPORT = """WITH r AS (SELECT doc_id AS line, md5(text) AS md5, source FROM documents),
p AS (SELECT 0 AS key_ord, 'md5' AS key, md5 AS value, line FROM r UNION ALL SELECT 1, 'source', source, line FROM r),
report AS (SELECT key_ord, key, value, count(*) AS count, string_agg(line::VARCHAR, ';' ORDER BY line) AS line_numbers FROM p WHERE value IS NOT NULL GROUP BY ALL HAVING count(*) >= 2)"""


def _report(spark, sf_dir, make=dedup.duplicate_report):
    rows = documents(spark, sf_dir).select(F.col("doc_id").alias("line"), F.md5("text").alias("md5"), "source")
    return make(rows, ["md5", "source"])


@query(f"{_REPORT} SELECT * FROM report")
def duplicate_report(spark, sf_dir):
    return _report(spark, sf_dir)


@query(
    f"{_REPORT} SELECT key, value, count, rank, more FROM (SELECT *, row_number() OVER (PARTITION BY key_ord ORDER BY count DESC, value)::INT AS rank, greatest(count(*) OVER (PARTITION BY key_ord) - 10, 0) AS more FROM report) WHERE rank <= 10"
)
def duplicate_preview(spark, sf_dir):
    return dedup.duplicate_preview(_report(spark, sf_dir, dedup.duplicate_counts)).select("key", "value", "count", "rank", "more")


@query(f"{_REPORT} SELECT key, value, count, line_numbers FROM report")
def duplicates_csv(spark, sf_dir):
    path = f"{scratch.folder(spark)}/duplicates_csv"
    records.write_duplicates(_report(spark, sf_dir, dedup.duplicate_pieces), path)
    return spark.read.option("header", "true").option("escape", '"').schema("key string, value string, count long, line_numbers string").csv(path)


ORACLES["dedup_with_near"] = (
    _MARKED.replace("WITH commits", "WITH RECURSIVE commits")
    + ", " + _sig_sql("SELECT seq AS doc_id, norm AS text FROM marked WHERE drop_reason IS NULL")
    + ", placed AS (SELECT seq, sig, row_number() OVER (ORDER BY seq) AS i FROM sigs), " + _WALK.replace("THRESHOLD", "3")
    + " SELECT seq, repo, sha FROM marked WHERE drop_reason IS NULL AND seq NOT IN (SELECT seq FROM gone)"
)


@query(f"WITH RECURSIVE {_SIG}, placed AS (SELECT seq, sig, row_number() OVER (ORDER BY seq) AS i FROM sigs), {_WALK.replace('THRESHOLD', '5')} SELECT seq FROM gone")
def near_duplicates_five_bits(spark, sf_dir):
    sigs = dedup.with_simhash(documents(spark, sf_dir).select(F.col("doc_id").alias("seq"), "text"), "text").select("seq", "sig")
    return dedup.near_duplicates(sigs, threshold=5)


# Parsing and projection


@query(f"{_WITH} SELECT seq, {_LABEL} AS label FROM commits WHERE {_LABEL} IS NOT NULL")
def conventional_commits(spark, sf_dir):
    return labelled(spark, sf_dir).where("label is not null").select("seq", "label")


_LOG = "SELECT doc_id AS seq, CASE WHEN doc_id % 17 = 0 THEN 'broken' ELSE concat(md5(doc_id::VARCHAR), '|~|', (1700000000 + doc_id)::VARCHAR, '|~|', message, '|~|x') END AS value FROM documents JOIN commits ON seq = doc_id"


@query(
    rf"""{_WITH}, lines AS ({_LOG}), log AS (SELECT seq, regexp_extract(value, '^(.*?)\|~\|(.*?)\|~\|(.*)$', 1) AS sha, regexp_extract(value, '^(.*?)\|~\|(.*?)\|~\|(.*)$', 2) AS epoch,
  regexp_extract(value, '^(.*?)\|~\|(.*?)\|~\|(.*)$', 3) AS message FROM lines WHERE value <> 'broken' ORDER BY seq LIMIT 200),
found AS (SELECT seq, sha, epoch, message AS subject, {_LABEL} AS label FROM log)
SELECT *, strftime(make_timestamp(epoch::BIGINT * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS labeled_at FROM found WHERE label IS NOT NULL ORDER BY seq LIMIT 100"""
)
def mined_log(spark, sf_dir):
    lines = commits(spark, sf_dir).select("seq", F.when(F.col("seq") % 17 == 0, "broken").otherwise(F.concat(F.md5(F.col("seq").cast("string")), F.lit("|~|"), (F.col("seq") + 1_700_000_000).cast("string"), F.lit("|~|"), "message", F.lit("|~|x"))).alias("value"))
    found = quotas.mined(ingest.parse_log(lines), 100)
    return found.withColumn("labeled_at", F.date_format(F.timestamp_seconds(F.col("epoch").cast("long")), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


@query(
    rf"""{_WITH} SELECT seq, concat('cc://', project, '/', sha) AS url, split_part(project, '/', 1) AS owner, CASE WHEN contains(project, '/') THEN split_part(project, '/', 2) ELSE project END AS repo, sha, message,
  substr(diff, 1, 20000) AS diff_text, n::BIGINT AS files_changed, additions, deletions, top_exts, label, '2024-01-01' AS labeled_at
FROM (SELECT seq, sha, message, {_LABEL} AS label, CASE WHEN seq % 2 = 0 THEN concat('org/', repo) ELSE repo END AS project, CASE WHEN seq % 4 = 0 THEN 2 ELSE 1 END AS n,
  concat('diff --git a/', path, ' b/', path, chr(10), '--- a/', path, chr(10), '+++ b/', path, chr(10), body,
    CASE WHEN seq % 4 = 0 THEN concat(chr(10), 'diff --git a/old.txt b//dev/null', chr(10), '--- a/old.txt', chr(10), '+++ b//dev/null', chr(10), '-gone') ELSE '' END) AS diff,
  len(list_filter(string_split(body, chr(10)), lambda l: l[1] = '+' and not starts_with(l, '+++'))) AS additions,
  len(list_filter(string_split(body, chr(10)), lambda l: l[1] = '-' and not starts_with(l, '---'))) + CASE WHEN seq % 4 = 0 THEN 1 ELSE 0 END AS deletions,
  concat('.', regexp_extract(path, '\.([a-z]+)$', 1), CASE WHEN seq % 4 = 0 THEN ',.txt' ELSE '' END) AS top_exts
  FROM (SELECT *, array_to_string(({_LINES})[6:], chr(10)) AS body FROM commits) WHERE seq % 10 <> 0) WHERE label IS NOT NULL"""
)
def normalized_mods(spark, sf_dir):
    body = F.array_join(F.slice(F.split("diff_text", "\n"), 6, 1 << 30), "\n")
    mod = lambda old, new, diff: F.struct(old.alias("old_path"), new.alias("new_path"), F.lit("MODIFY").alias("change_type"), diff.alias("diff"))
    one, two = mod(F.col("path"), F.col("path"), body), mod(F.lit("old.txt"), F.lit(None).cast("string"), F.lit("-gone"))
    mods = F.when(F.col("seq") % 10 == 0, F.array().cast("array<struct<old_path:string,new_path:string,change_type:string,diff:string>>")).when(F.col("seq") % 4 == 0, F.array(one, two)).otherwise(F.array(one))
    rows = commits(spark, sf_dir).select("seq", F.concat(F.lit(" \n"), "message", F.lit("\nbody ")).alias("message"), F.when(F.col("seq") % 2 == 0, F.concat(F.lit("org/"), "repo")).otherwise(F.col("repo")).alias("repo"), F.col("sha").alias("hash"), F.lit("2024-01-01").alias("date"), mods.alias("mods"))
    return ingest.normalize(rows, "commitchronicle")


@query(
    rf"""{_WITH} SELECT seq, concat('cb://', project, '/', sha) AS url, split_part(project, '/', 1) AS owner, CASE WHEN contains(project, '/') THEN split_part(project, '/', 2) ELSE project END AS repo, sha, message,
  substr(diff_text, 1, 20000) AS diff_text, 1::BIGINT AS files_changed, len({_ADDED})::BIGINT AS additions, len({_DELETED})::BIGINT AS deletions, concat('.', regexp_extract(path, '\.([a-z]+)$', 1)) AS top_exts, label
FROM (SELECT *, {_LABEL} AS label, CASE WHEN seq % 5 = 0 THEN 'unknown/unknown' ELSE concat('org/', repo) END AS project FROM commits) WHERE label IS NOT NULL"""
)
def normalized_aliases(spark, sf_dir):
    pick = lambda n, c: F.when(F.col("seq") % 3 == n, F.col(c)).otherwise(F.lit("") if n == 0 else F.lit(None).cast("string"))
    rows = commits(spark, sf_dir).select(
        "seq", pick(0, "message").alias("message"), pick(1, "message").alias("commit_message"), pick(2, "message").alias("subject"), pick(0, "diff_text").alias("diff"), pick(1, "diff_text").alias("patch"),
        pick(2, "diff_text").alias("diff_text"), F.when(F.col("seq") % 5 == 0, "").otherwise(F.concat(F.lit("org/"), "repo")).alias("project"), F.lit(None).cast("string").alias("repo"), F.col("sha").alias("hash"),
    )
    return ingest.normalize(rows, "commitbench").drop("labeled_at")


@query(
    """SELECT md5(doc_id::VARCHAR) AS sha, CASE WHEN doc_id % 11 = 0 THEN 0 ELSE 2 END::BIGINT AS files_changed, CASE WHEN doc_id % 11 = 0 THEN 0 ELSE doc_id % 50 + 3 END::BIGINT AS additions,
  CASE WHEN doc_id % 11 = 0 THEN 0 ELSE doc_id % 7 + 1 END::BIGINT AS deletions, CASE WHEN doc_id % 11 = 0 THEN '' ELSE concat('.', lower(lang), ',.md') END AS top_exts FROM documents"""
)
def numstat_sums(spark, sf_dir):
    id_ = F.col("doc_id")
    real = F.concat((id_ % 50).cast("string"), F.lit("\t"), (id_ % 7).cast("string"), F.lit("\tsrc/a b."), F.upper("lang"), F.lit("\n\n3\t1\tREADME.md\n"))
    stat = F.concat(F.when(id_ % 11 == 0, "").otherwise(real), F.lit("-\t-\timg/x.png"))
    return ingest.numstat(documents(spark, sf_dir).select(F.md5(id_.cast("string")).alias("sha"), stat.alias("stat")))


@query(f"{_WITH} SELECT seq, len({_ADDED})::INT AS added, len({_DELETED})::INT AS deleted FROM commits")
def diff_line_counts(spark, sf_dir):
    d = F.col("diff_text")
    return commits(spark, sf_dir).select("seq", F.size(T.added_lines(d)).alias("added"), F.size(T.deleted_lines(d)).alias("deleted"))


@query(rf"{_WITH} SELECT seq, array_to_string({_PATHS}, ',') AS paths, greatest(len(list_distinct({_PATHS})), 1)::INT AS files_changed, concat('.', regexp_extract(path, '\.([a-z]+)$', 1)) AS top_exts FROM commits")
def changed_paths(spark, sf_dir):
    paths = T.changed_paths(F.col("diff_text"))
    return commits(spark, sf_dir).select("seq", F.array_join(paths, ",").alias("paths"), F.greatest(F.size(F.array_distinct(paths)), F.lit(1)).alias("files_changed"), T.top_extensions(paths).alias("top_exts"))


@query(
    "SELECT doc_id, md5(CASE WHEN length(text) > 1000 THEN concat(substr(text, 1, 1000), chr(10), '[TRUNCATED]') ELSE text END) AS cut_md5, coalesce(try_cast(lang AS DOUBLE), 0) AS no_number, coalesce(try_cast(n_chars::VARCHAR AS DOUBLE), 0) / (length(text) % 5 + 1) AS ratio, nullif(string_split(trim(text, chr(10) || ' '), chr(10))[1], '') AS first_line FROM documents"
)
def coerced_columns(spark, sf_dir):
    text = F.col("text")
    return documents(spark, sf_dir).select(
        "doc_id", F.md5(T.truncate(text, 1000, "\n[TRUNCATED]")).alias("cut_md5"), D.number(F.col("lang")).alias("no_number"),
        D.add_del_ratio(D.number(F.col("n_chars").cast("string")), F.length(text) % 5).alias("ratio"), T.first_line(text).alias("first_line"),
    )


_RULE_CASES = """SELECT seq, CASE seq % 8 WHEN 0 THEN [path] WHEN 1 THEN [path, 'docs/x.txt'] WHEN 2 THEN ['.github/workflows/docs/ci.md'] WHEN 3 THEN ['tests/a.py', 'src/b.py'] WHEN 4 THEN ['src/readme.md', 'LICENSE']
  WHEN 5 THEN ['x/test_a.py', 'y/b_test.go', 'FooTests.cs'] WHEN 6 THEN ['Tests/x.py'] ELSE [] END AS files FROM commits"""


def _all(pattern: str) -> str:
    return f"(len(files) > 0 AND len(list_filter(files, lambda f: NOT regexp_matches(f, '{pattern}'))) = 0)"


@query(f"{_WITH}, c AS ({_RULE_CASES}) SELECT seq, CASE " + " ".join(f"WHEN {_all(p)} THEN '{label}'" for label, p, _ in rules.RULES) + " END AS hit FROM c")
def path_rules(spark, sf_dir):
    cases = [["{path}"], ["{path}", "docs/x.txt"], [".github/workflows/docs/ci.md"], ["tests/a.py", "src/b.py"], ["src/readme.md", "LICENSE"], ["x/test_a.py", "y/b_test.go", "FooTests.cs"], ["Tests/x.py"], []]
    files = F.array().cast("array<string>")
    for i, case in enumerate(cases):
        files = F.when(F.col("seq") % 8 == i, F.array(*[F.col("path") if x == "{path}" else F.lit(x) for x in case]).cast("array<string>")).otherwise(files)
    return commits(spark, sf_dir).select("seq", rules.classify(files).alias("hit"))


# Quotas and counts

_CAPPED = "ranked AS (SELECT doc_id AS seq, lang AS label, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents), kept AS (SELECT seq, label FROM ranked WHERE n <= 60 ORDER BY seq LIMIT 200)"


def _langs(spark, sf_dir):
    return documents(spark, sf_dir).select(F.col("doc_id").alias("seq"), F.col("lang").alias("label"))


@query(f"WITH {_CAPPED} SELECT * FROM kept")
def label_quota(spark, sf_dir):
    return quotas.apply_quota(_langs(spark, sf_dir), 60, 200)


@query(f"WITH {_CAPPED} SELECT (SELECT count(*) FROM kept) AS kept, (SELECT count(*) FROM ranked WHERE n > 60 AND ((SELECT count(*) FROM kept) < 200 OR seq < (SELECT max(seq) FROM kept))) AS capped")
def quota_counters(spark, sf_dir):
    return quotas.quota_counts(_langs(spark, sf_dir), 60, 200)


@query(f"{_WITH} SELECT DISTINCT {_LABEL} AS label FROM commits WHERE {_LABEL} IS NOT NULL")
def distinct_labels(spark, sf_dir):
    text = records.labels_text(labelled(spark, sf_dir))
    return spark.createDataFrame([(x,) for x in text.split("\n")], "label string")


# Features


@query(
    rf"{_WITH} SELECT seq, array_to_string(list_sort(list_distinct(list_transform(list_filter(flatten(list_transform({_PATHS}, lambda p: regexp_split_to_array(p, '[/\-_.]'))), lambda x: length(x) > 2), lambda x: lower(x)))), ' ') AS tokens, regexp_extract(path, '\.([a-z]+)$', 1) AS exts FROM commits"
)
def path_tokens(spark, sf_dir):
    d = F.col("diff_text")
    return commits(spark, sf_dir).select("seq", F.array_join(D.path_tokens(d), " ").alias("tokens"), F.array_join(D.extensions(d), " ").alias("exts"))


def _words(lines: str) -> str:
    return rf"list_distinct(regexp_extract_all(lower(array_to_string(list_transform({lines}, lambda l: l[2:]), chr(10))), '[\pL\pN_]+'))"


@query(f"{_WITH} SELECT seq, CASE WHEN len(a) + len(d) = 0 THEN 0 ELSE round(len(list_intersect(a, d)) / len(list_distinct(list_concat(a, d))), 9) END AS jaccard FROM (SELECT seq, {_words(_ADDED)} AS a, {_words(_DELETED)} AS d FROM commits)")
def change_jaccard(spark, sf_dir):
    return commits(spark, sf_dir).select("seq", F.round(D.change_jaccard(F.col("diff_text")), 9).alias("jaccard"))


_TERMS = r"terms AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\pL\pN_]{2,}')) AS term FROM documents)"
_VOCAB = f"""{_TERMS}, stats AS (SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM terms GROUP BY term ORDER BY tf DESC, term LIMIT 2000),
vocab AS (SELECT term, tf, df, ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1 AS idf, (row_number() OVER (ORDER BY term) - 1)::INT AS idx FROM stats)"""


def _vocabulary(spark, sf_dir):
    return features.vocabulary(documents(spark, sf_dir), D.tokens(F.col("text")), 2000)


@query(f"WITH {_VOCAB} SELECT term, tf, df, round(idf, 9) AS idf, idx FROM vocab")
def tfidf_vocabulary(spark, sf_dir):
    return _vocabulary(spark, sf_dir).withColumn("idf", F.round("idf", 9))


@query(
    f"WITH {_VOCAB}, w AS (SELECT doc_id, idx, count(*) * any_value(idf) AS v FROM terms JOIN vocab USING (term) GROUP BY doc_id, idx) SELECT doc_id, idx, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 7) AS value FROM w"
)
def tfidf_vectors(spark, sf_dir):
    vocab, _ = scratch.keep(_vocabulary(spark, sf_dir))
    return features.tfidf(documents(spark, sf_dir), "doc_id", D.tokens(F.col("text")), vocab).withColumn("value", F.round("value", 7))


@query(f"WITH {_VOCAB} SELECT DISTINCT doc_id, idx, 1.0::DOUBLE AS value FROM terms JOIN vocab USING (term)")
def binary_vectors(spark, sf_dir):
    vocab, _ = scratch.keep(_vocabulary(spark, sf_dir))
    return features.binary_counts(documents(spark, sf_dir), "doc_id", D.tokens(F.col("text")), vocab)


@query("SELECT 'l_quantity' AS name, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS scale FROM lineitem UNION ALL SELECT 'l_tax', round(avg(l_tax), 6), round(stddev_pop(l_tax), 6) FROM lineitem")
def scaler(spark, sf_dir):
    made = features.scaler(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_quantity", "l_tax"])
    return made.select("name", F.round("mean", 6).alias("mean"), F.round("scale", 6).alias("scale"))


def _numbered(spark, sf_dir):
    d = F.col("diff_text")
    rows = labelled(spark, sf_dir).where("label is not null").withColumns({"files_changed": F.lit("1"), "additions": F.size(T.added_lines(d)), "deletions": F.size(T.deleted_lines(d))})
    return features.inputs(rows)


@query()
def assembled_features(spark, sf_dir):
    rows, _ = scratch.keep(_numbered(spark, sf_dir))
    return features.transform(rows, features.fit(rows))


@query()
def fitted_scores(spark, sf_dir):
    """Fits all labels at the operators' default sizes, takes the payload through JSON, and scores every commit."""
    rows, _ = scratch.keep(_numbered(spark, sf_dir))
    spec = features.fit(rows)
    vectors, _ = scratch.keep(features.transform(rows, spec).join(rows.select("seq", "label"), "seq"))
    model = training.fit(vectors, spec.width)
    path = f"{scratch.folder(spark)}/payload"
    payloads.write_payload(spark, payloads.export_payload(spec, model), path)
    _, model = payloads.import_payload(payloads.read_payload(spark, path))
    return scoring.top_k(scoring.score(vectors, model), model.classes)


@query(
    f"""{_WITH} SELECT 'features' AS stage, count(*) AS n, 0::BIGINT AS differing FROM commits WHERE {_LABEL} IS NOT NULL
UNION ALL SELECT 'classifier', count(*), 0::BIGINT FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)"""
)
def persisted_stages(spark, sf_dir):
    """Rows that saved and loaded stages of a pipeline make other than the functions do: features at their default sizes, and the made-up classifier."""
    path = f"{scratch.folder(spark)}/stages_{uuid.uuid4().hex}"
    rows, _ = scratch.keep(_numbered(spark, sf_dir))
    lines, _ = scratch.keep(_lines(spark, sf_dir).dropDuplicates(["seq"]))
    fitted = stages.DiffFeatures().fit(rows)
    for name, model in (("features", fitted), ("classifier", stages.CalibratedSVCModel(_made_up()))):
        PipelineModel([model]).save(f"{path}/{name}")
    load = lambda name: PipelineModel.load(f"{path}/{name}")
    x = features.transform(rows, fitted.spec).join(load("features").transform(rows).select("seq", F.col("indices").alias("i"), F.col("values").alias("v")), "seq", "full")
    p = scoring.score(lines, _made_up()).join(load("classifier").transform(lines).select("seq", F.col("probs").alias("p")), "seq", "full")
    count = lambda df, name, same: df.agg(F.count("*").alias("n"), F.count_if(~F.coalesce(same, F.lit(False))).alias("differing")).select(F.lit(name).alias("stage"), "n", "differing")
    return count(x, "features", (F.col("indices") == F.col("i")) & (F.col("values") == F.col("v"))).union(count(p, "classifier", F.col("probs") == F.col("p")))


@query(
    f"""{_WITH}, l AS (SELECT seq, {_LABEL} AS label FROM commits), f AS (SELECT label, ((row_number() OVER (PARTITION BY label ORDER BY md5('42:' || seq), seq) - 1) % 3)::INT AS fold FROM l WHERE label IS NOT NULL)
SELECT a.fold, b.label, count(*) FILTER (WHERE f.fold <> a.fold AND f.label = b.label) AS taught, count(*) FILTER (WHERE f.fold = a.fold AND f.label = b.label) AS calibrated, true AS at_minimum
FROM f, (SELECT DISTINCT fold FROM f) a, (SELECT DISTINCT label FROM f) b GROUP BY a.fold, b.label"""
)
def fitted_minimum(spark, sf_dir):
    """Of each class in each fold how many of its rows teach and calibrate, and whether the fitted coefficients are at their minimum.

    They are if the gradient there, summed anew over exploded rows, is at most 1e-6 of the gradient at 0.
    """
    rows, _ = scratch.keep(_numbered(spark, sf_dir))
    spec = features.fit(rows, max_terms=1_000, max_paths=100)
    vectors, _ = scratch.keep(features.transform(rows, spec).join(rows.select("seq", "label"), "seq"))
    model = training.fit(vectors, spec.width)
    placed, _ = scratch.keep(training.with_fold(vectors))
    return evaluation.at_minimum(placed, model).select("fold", "label", "taught", "calibrated", "at_minimum")


# Scoring and evaluation: a small made-up model, so that SQL can follow the algebra

#: Made-up values: weights of (quantity, discount, tax) for three classes in two folds, with sigmoids.
CLASSES = ["chore", "feat", "fix"]
FOLDS = [
    ([[0.05, 2.0, -1.0], [-0.03, 1.0, 3.0], [0.01, -4.0, 2.0]], [0.1, -0.2, 0.3], [-1.2, -0.8, -1.0], [0.1, 0.0, -0.1]),
    ([[0.04, 1.0, -2.0], [-0.02, 2.0, 1.0], [0.02, -3.0, 1.0]], [0.0, 0.1, -0.1], [-1.0, -1.1, -0.9], [0.0, 0.2, 0.1]),
]


def _probs_sql() -> str:
    margin = lambda f, c: f"({' + '.join(f'{w} * {x}' for w, x in zip(FOLDS[f][0][c], ('l_quantity', 'l_discount', 'l_tax')))} + {FOLDS[f][1][c]})"
    p = lambda f, c: f"1 / (1 + exp({FOLDS[f][2][c]} * {margin(f, c)} + {FOLDS[f][3][c]}))"
    raw = ", ".join(f"{p(f, c)} AS p{f}{c}" for f in range(2) for c in range(3))
    mean = ", ".join(f"(p0{c} / (p00 + p01 + p02) + p1{c} / (p10 + p11 + p12)) / 2 AS q{c}" for c in range(3))
    rows = " UNION ALL ".join(f"SELECT seq, {c} AS class_idx, '{CLASSES[c]}' AS label, q{c} AS prob FROM q" for c in range(3))
    return f"WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS seq, {raw} FROM lineitem), q AS (SELECT seq, {mean} FROM r), probs AS ({rows})"


_PROBS = _probs_sql()


def _lines(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.array(F.lit(0), F.lit(1), F.lit(2)).alias("indices"), F.array("l_quantity", "l_discount", "l_tax").alias("values"))


def _made_up():
    import numpy as np

    return scoring.Model(CLASSES, [scoring.Fold(*(np.array(x, float) for x in f)) for f in FOLDS])


def _probs(spark, sf_dir):
    return scoring.score(_lines(spark, sf_dir), _made_up())


#: Of each line the two best classes, and a made-up label of a path rule.
_BEST = f"""{_PROBS.split(", probs AS (")[0]}, b AS MATERIALIZED (SELECT seq, CASE seq % 3 WHEN 0 THEN 'fix' WHEN 1 THEN 'ci' END AS hit,
  list_sort([{", ".join(f"{{'less': -q{c}, 'class_idx': {c}, 'label': '{x}'}}" for c, x in enumerate(CLASSES))}])[1:2] AS best FROM q)"""


@query(f"{_PROBS} SELECT seq, class_idx, label, round(prob, 9) AS prob FROM probs")
def forward_pass(spark, sf_dir):
    return scoring.long_form(_probs(spark, sf_dir), CLASSES).withColumn("prob", F.round("prob", 9))


@query(f"{_BEST} SELECT seq, best[1].label AS label FROM b")
def predicted_labels(spark, sf_dir):
    return scoring.predict(_probs(spark, sf_dir), CLASSES)


@query(f"{_BEST} SELECT seq, best[k].class_idx AS class_idx, best[k].label AS label, round(-best[k].less, 9) AS prob, k AS rank FROM b, (VALUES (1), (2)) AS r(k)")
def top_labels(spark, sf_dir):
    return scoring.top_k(_probs(spark, sf_dir), CLASSES, 2).withColumn("prob", F.round("prob", 9))


def _hits(spark, sf_dir):
    seq = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(seq.alias("seq")).distinct().withColumn("hit", F.when(F.col("seq") % 3 == 0, "fix").when(F.col("seq") % 3 == 1, "ci"))


@query(f"{_BEST} SELECT seq, CASE WHEN best[2].label = hit THEN best[2].label ELSE best[1].label END AS label, CASE WHEN best[2].label = hit THEN 2 ELSE 1 END AS chosen_rank FROM b")
def preselected_labels(spark, sf_dir):
    return scoring.preselect(_probs(spark, sf_dir), CLASSES, _hits(spark, sf_dir), 2)


@query(f"{_BEST} SELECT seq, hit AS label, 1.0::DOUBLE AS prob, 1 AS rank FROM b WHERE hit IS NOT NULL UNION ALL SELECT seq, best[k].label, round(-best[k].less, 9), k FROM b, (VALUES (1), (2)) AS r(k) WHERE hit IS NULL")
def short_circuited_labels(spark, sf_dir):
    return scoring.short_circuit(_probs(spark, sf_dir), CLASSES, _hits(spark, sf_dir), 2).withColumn("prob", F.round("prob", 9))


@query("SELECT l_orderkey, l_linenumber, round(exp(l_tax - m) / (exp(l_tax - m) + exp(l_discount - m)), 9) AS first FROM (SELECT *, greatest(l_tax, l_discount) AS m FROM lineitem)")
def softmax(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.round(scoring.softmax(F.array("l_tax", "l_discount"))[0], 9).alias("first"))


def _pairs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("quality").cast("string").alias("y"), F.col("toxic").cast("string").alias("pred"))


@query(
    """WITH p AS (SELECT quality::VARCHAR AS y, toxic::VARCHAR AS pred FROM labels), l AS (SELECT DISTINCT y AS label FROM p UNION SELECT DISTINCT pred FROM p),
s AS (SELECT label, (SELECT count(*) FROM p WHERE y = label AND pred = label) AS hit, (SELECT count(*) FROM p WHERE y = label) AS support, (SELECT count(*) FROM p WHERE pred = label) AS said FROM l),
m AS (SELECT label, coalesce(hit / nullif(said, 0), 0) AS precision, coalesce(hit / nullif(support, 0), 0) AS recall, support, hit FROM s),
f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM m), n AS (SELECT sum(support)::BIGINT AS n FROM f),
out AS (SELECT label, precision, recall, f1, support FROM f
UNION ALL SELECT 'accuracy', sum(hit) / any_value(n), sum(hit) / any_value(n), sum(hit) / any_value(n), any_value(n) FROM f, n
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), any_value(n) FROM f, n
UNION ALL SELECT 'weighted avg', sum(precision * support) / any_value(n), sum(recall * support) / any_value(n), sum(f1 * support) / any_value(n), any_value(n) FROM f, n)
SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM out"""
)
def classification_report(spark, sf_dir):
    r = evaluation.report(_pairs(spark, sf_dir))
    return r.select("label", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("SELECT quality::VARCHAR AS y, count(*) FILTER (WHERE toxic = 0) AS \"0\", count(*) FILTER (WHERE toxic = 1) AS \"1\" FROM labels GROUP BY quality")
def confusion_matrix(spark, sf_dir):
    return evaluation.confusion(_pairs(spark, sf_dir), ["1", "0"])


@query("SELECT count(*) AS n, max(abs(value - floor(value))) AS max_abs_diff, count(*) FILTER (WHERE abs(value - floor(value)) > 0.5) AS over_tolerance, count(*) FILTER (WHERE abs(value - floor(value)) > 0.5) = 0 AS ok FROM events")
def parity_check(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return evaluation.parity(events.select("event_id", "value"), events.select("event_id", F.floor("value").cast("double").alias("value")), "event_id", "value", 0.5)


@query("SELECT count(*) AS n, 0.0::DOUBLE AS max_abs_diff, 0::BIGINT AS over_tolerance, true AS same_classes, true AS ok FROM (SELECT l_orderkey, l_linenumber, count(*) AS c FROM lineitem GROUP BY ALL) a JOIN lineitem USING (l_orderkey, l_linenumber) WHERE c = 1")
def payload_parity(spark, sf_dir):
    """Scores of the made-up model and of what its exported JSON makes of it, for lines with a number of their own."""
    import json

    import numpy as np

    model = scoring.Model(CLASSES, [scoring.Fold(*(np.array(x, float) for x in f)) for f in FOLDS])
    spec = features.Spec(["a", "b"], [1.0, 1.0], ["p"], ["e"], [0.0] * 4, [1.0] * 4)
    _, again = payloads.import_payload(json.loads(json.dumps(payloads.export_payload(spec, model))))
    lines = _lines(spark, sf_dir)
    once = lines.join(lines.groupBy("seq").agg(F.count("*").alias("c")).where("c = 1").select("seq"), "seq")
    return evaluation.verify_scores(scoring.score(once, model), scoring.score(once, again), model.classes, again.classes)


@query("SELECT doc_id AS seq, lang AS label, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) <= round(count(*) OVER (PARTITION BY lang) * 0.1) AS is_test FROM documents")
def stratified_split(spark, sf_dir):
    return evaluation.stratified_split(_langs(spark, sf_dir))


@query("SELECT doc_id AS seq, lang AS label FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 20")
def seeded_head(spark, sf_dir):
    return evaluation.seeded_head(_langs(spark, sf_dir), 20, 7)


# Records in files, and streams


@query(f"{_WITH} SELECT seq, repo, nullif(sha, '') AS sha, message FROM commits")
def jsonl_round_trip(spark, sf_dir):
    rows = commits(spark, sf_dir).select("seq", "repo", F.nullif("sha", F.lit("")).alias("sha"), "message")
    path = f"{scratch.folder(spark)}/jsonl_round_trip"
    records.write_jsonl(rows.where("seq % 2 = 0"), path)
    records.write_jsonl(rows.where("seq % 2 = 1"), path, append=True)
    return spark.read.schema(rows.schema).json(path)


def _documents_of(rows, before, between, after):
    """Lines of one document for each partition: every row's JSON, and what stands around and between them."""
    import pyarrow as pa

    def run(batches):
        first = True
        for batch in batches:
            lines = batch.column("value").to_pylist()
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array([(before if first else "") + (between.join(lines) if first else between + between.join(lines))])], names=["value"])
                first = False
        if not first:
            yield pa.RecordBatch.from_arrays([pa.array([after])], names=["value"])

    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).repartition(4).mapInArrow(run, "value string")


@query(f"{_WITH} SELECT seq, repo, sha, message FROM commits")
def json_array_records(spark, sf_dir):
    """Commits written as files that are arrays, objects with an array under data, and broken arrays with a record a line, all read at once."""
    path = f"{scratch.folder(spark)}/json_arrays_{uuid.uuid4().hex}"
    rows = commits(spark, sf_dir).select(F.col("seq").alias("n"), "repo", "sha", "message")
    for i, around in enumerate((("[", ",", "]"), ('{"meta": [1, 2], "data": [', ", ", ']}'), ("[\n", "\n", "\n"))):
        _documents_of(rows.where(F.col("n") % 3 == i), *around).write.text(f"{path}/{i}")
    files = sorted(f for i in range(3) for f in spark.read.text(f"{path}/{i}").inputFiles())
    return records.read_records(spark, files, rows.schema).select(F.col("n").alias("seq"), "repo", "sha", "message")


def _streamed(spark, sf_dir, make, mode="append"):
    """What a stream over the documents, each bucket a file, writes until its input ends."""
    base = f"{scratch.folder(spark)}/stream_{make.__name__}_{abs(hash((sf_dir, mode))) % 10**9}"
    source = labelled(spark, sf_dir).where("label is not null").select("seq", "repo", "sha", "label", "diff_text")
    scratch.drop(spark, base)
    source.write.mode("overwrite").parquet(f"{base}/in")
    stream = make(spark.readStream.schema(source.schema).parquet(f"{base}/in"))

    def put(batch, number):
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    run = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(put).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out").drop("batch")


def _dedup(df):
    return streams.deduplicate_stream(df)


def _counts(df):
    return streams.label_counts_stream(df)


def _quota(df):
    return streams.quota_stream(df, 5)


@query(f"{_WITH} SELECT count(DISTINCT CASE WHEN sha <> '' THEN repo || '/' || sha END) AS shas, max(1)::INT AS most FROM commits WHERE {_LABEL} IS NOT NULL")
def stream_first_seen(spark, sf_dir):
    """How many shas a stream that keeps the first of each has seen, and how often it kept one at most."""
    kept = _streamed(spark, sf_dir, _first_of_sha)
    per = kept.groupBy("repo", "sha").agg(F.count("*").alias("n")).where("sha <> ''")
    return per.agg(F.count("*").alias("shas"), F.max("n").cast("int").alias("most"))


def _first_of_sha(df):
    return df.select("repo", "sha").dropDuplicates(["repo", "sha"])


@query()
def stream_dedup(spark, sf_dir):
    return _streamed(spark, sf_dir, _dedup)


@query(f"{_WITH} SELECT {_LABEL} AS label, count(*) AS n FROM commits WHERE {_LABEL} IS NOT NULL GROUP BY 1")
def stream_label_counts(spark, sf_dir):
    return _streamed(spark, sf_dir, _counts, "complete")


@query(f"{_WITH} SELECT {_LABEL} AS label, least(count(*), 5) AS n FROM commits WHERE {_LABEL} IS NOT NULL GROUP BY 1")
def stream_quota(spark, sf_dir):
    return _streamed(spark, sf_dir, _quota).groupBy("label").agg(F.count("*").alias("n"))
