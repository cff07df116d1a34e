"""The commit record, and what producers of it read."""

from pyspark.sql import types as T

COMMIT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("url", "owner", "repo", "sha", "message", "diff_text")]
    + [T.StructField(n, T.LongType()) for n in ("files_changed", "additions", "deletions")]
    + [T.StructField(n, T.StringType()) for n in ("top_exts", "label", "labeled_at")]
)

#: Rows of the first external source: one array of modified files for each commit.
MODS = "message string, repo string, hash string, date string, mods array<struct<old_path: string, new_path: string, change_type: string, diff: string>>"
#: Rows of the second: its releases name fields differently, so all names are read.
ALIASES = "message string, commit_message string, subject string, diff string, patch string, diff_text string, project string, repo string, hash string"

#: The labels of conventional commits.
LABELS = ["feat", "fix", "docs", "style", "refactor", "perf", "test", "build", "ci", "chore", "revert"]
#: Fixed value: code points of a diff that are kept.
MAX_DIFF = 20_000
