"""Commit records from a git log, and from external sources of differing shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commitloom.functions import text as T
from commitloom.schema import MAX_DIFF


def parse_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """sha, epoch, subject of log lines of three fields between |~|; others are skipped."""
    parts = F.split(F.col(column), r"\|~\|", 3)
    return lines.where(F.size(parts) == 3).select(*[c for c in lines.columns if c != column], *[parts[i].alias(n) for i, n in enumerate(("sha", "epoch", "subject"))])


def numstat_of(stat: Column, skip_binary: bool = True) -> Column:
    """struct<files_changed, additions, deletions, top_exts> of a numstat text, within the row.

    Fields are between white space and the third goes to the line's end. Binary files, which have a dash
    for a number, are skipped, or counted with no lines if not ``skip_binary``. Texts without a counted file,
    null ones too, have zeros.
    """
    number = lambda x: F.coalesce(x.try_cast("long"), F.lit(0))
    fields = F.transform(T.lines(F.coalesce(stat, F.lit(""))), lambda x: F.split(F.regexp_replace(x, r"(?U)^\s+", ""), r"(?U)\s+", 3))
    counted = F.filter(fields, lambda f: (F.size(f) == 3) & (((F.get(f, 0) != "-") & (F.get(f, 1) != "-")) if skip_binary else F.lit(True)))
    total = lambda fs, i: F.aggregate(fs, F.lit(0).cast("long"), lambda n, f: n + number(f[i]))
    return T.let(
        counted,
        lambda fs: F.struct(
            F.size(fs).cast("long").alias("files_changed"), total(fs, 0).alias("additions"), total(fs, 1).alias("deletions"),
            F.coalesce(T.top_extensions(F.transform(fs, lambda f: f[2])), F.lit("")).alias("top_exts"),
        ),
    )


def numstat(shows: DataFrame, skip_binary: bool = True) -> DataFrame:
    """sha, files_changed, additions, deletions, top_exts of numstat texts (sha, stat), see ``numstat_of``."""
    return shows.select("sha", numstat_of(F.col("stat"), skip_binary).alias("_s")).select("sha", "_s.*")


def mined_records(shown: DataFrame, repo: Column) -> DataFrame:
    """Commit records of local repositories from their labelled log and shows (sha, epoch, subject, label, stat, diff).

    Commits without a diff are dropped. Times are UTC. Nothing is shuffled.
    """
    kept = shown.where(F.coalesce("diff", F.lit("")) != "").withColumn("_s", numstat_of(F.col("stat"))).withColumn("_repo", repo)
    return kept.select(
        F.concat(F.lit("local://"), "_repo", F.lit("/"), "sha").alias("url"), F.lit("local").alias("owner"), F.col("_repo").alias("repo"), "sha", F.col("subject").alias("message"),
        T.truncate(F.col("diff"), MAX_DIFF, "\n[TRUNCATED]").alias("diff_text"), "_s.files_changed", "_s.additions", "_s.deletions", "_s.top_exts", "label",
        F.date_format(F.timestamp_seconds(F.col("epoch").cast("long")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("labeled_at"),
    )


def _record(rows: DataFrame, scheme: str, project: Column, paths: Column, files: Column, date: Column) -> DataFrame:
    """The record that both external sources share, from rows with _first and _diff."""
    sha = F.coalesce("hash", F.lit(""))
    label = T.conventional_label(F.col("_first"))
    kept = rows.withColumn("_label", label).where(F.col("_label").isNotNull() & T.not_blank(F.col("_diff"))).withColumn("_lines", T.line_counts(F.col("_diff")))
    return kept.select(
        *[c for c in ("seq",) if c in rows.columns], F.concat(F.lit(f"{scheme}://"), project, F.lit("/"), sha).alias("url"), T.owner_of(project).alias("owner"), T.name_of(project).alias("repo"),
        sha.alias("sha"), F.col("_first").alias("message"), T.truncate(F.col("_diff")).alias("diff_text"), files.cast("long").alias("files_changed"),
        F.col("_lines.added").alias("additions"), F.col("_lines.deleted").alias("deletions"),
        T.top_extensions(paths).alias("top_exts"), F.col("_label").alias("label"), date.alias("labeled_at"),
    )


def _now() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")


def from_mods(rows: DataFrame) -> DataFrame:
    """Records of the source that lists each commit's modified files."""
    kept = rows.where(F.size(F.coalesce("mods", F.array())) > 0)
    kept = kept.withColumn("_first", T.first_line(F.coalesce("message", F.lit("")))).withColumn("_diff", T.rebuild_diff(F.col("mods")))
    return _record(kept, "cc", T.first_of("repo", default="unknown/unknown"), T.mod_paths(F.col("mods")), F.size("mods"), F.coalesce(F.nullif("date", F.lit("")), _now()))


def from_aliases(rows: DataFrame) -> DataFrame:
    """Records of the source whose releases name their fields differently."""
    kept = rows.withColumn("_first", T.first_line(T.first_of("message", "commit_message", "subject", default="")))
    kept = kept.withColumn("_diff", T.first_of("diff", "patch", "diff_text", default=""))
    paths = T.changed_paths(F.col("_diff"))
    return _record(kept, "cb", T.first_of("project", "repo", default="unknown/unknown"), paths, F.greatest(F.size(F.array_distinct(paths)), F.lit(1)), _now())


#: Source name to what makes records of its rows.
NORMALIZERS = {"commitchronicle": from_mods, "commitbench": from_aliases}


def normalize(rows: DataFrame, source: str) -> DataFrame:
    if source not in NORMALIZERS:
        raise ValueError(f"unknown source {source!r}; known are {sorted(NORMALIZERS)}")
    return NORMALIZERS[source](rows)
