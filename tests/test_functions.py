import re

import pytest
from pyspark.sql import functions as F

from commitloom.functions import diff_features as D
from commitloom.functions import rules
from commitloom.functions import text as T


def one(spark, schema, value, *columns):
    return tuple(spark.createDataFrame([(value,)], schema).select(*columns).first())


@pytest.mark.parametrize("subject,label", [("feat(api)!: x", "feat"), ("Feat: x", None), ("feat:x", None), ("feat: ", None), ("revert: y z", "revert"), ("fix(): x", None), ("wip: x", None), ("xfeat: x", None)])
def test_conventional(spark, subject, label):
    assert one(spark, "s string", subject, T.conventional_label(F.col("s")))[0] == label


def test_lines_and_normalization(spark):
    a = "index abc1234..def5678 100644\n@@ -1,3 +1,3 @@\n+x  \n\n \t\nAuthor: me\nDate: now\ncommit abc\n y "
    b = "@@ -9,9 +9,9 @@\r\n+x\x85 y"
    df = spark.createDataFrame([(a,), (b,)], "d string").select(T.normalize_diff(F.col("d")).alias("n")).collect()
    assert df[0].n == df[1].n == "+x\n y"


def test_diff_lines_and_jaccard(spark):
    d = "--- a/x\n+++ b/x\n+one two\n-two three\n--- note\n+++more\n context"
    assert one(spark, "d string", d, F.size(T.added_lines(F.col("d"))), F.size(T.deleted_lines(F.col("d"))), D.change_jaccard(F.col("d"))) == (1, 1, pytest.approx(1 / 3))
    assert one(spark, "d string", " only context", D.change_jaccard(F.col("d")))[0] == 0.0


def test_paths_and_extensions(spark):
    d = "diff --git a/.gitignore b/.gitignore\n--- a/.gitignore\n+++ b/.gitignore\ndiff --git a/a/b/archive.tar.gz b/a/b/archive.tar.gz\n+++ b/a/b/archive.tar.gz"
    c = F.col("d")
    assert one(spark, "d string", d, T.changed_paths(c), D.path_tokens(c), D.extensions(c)) == ([".gitignore", "a/b/archive.tar.gz"], ["archive", "gitignore", "tar"], ["gz"])
    assert one(spark, "d string", "diff --git a/x.py b/x.py\n+++ /dev/null", T.changed_paths(c), D.extensions(c)) == (["x.py"], ["py"])


def test_top_extensions(spark):
    paths = ["a/b.PY", "c.md", ".gitignore", "d.py", "e.tar.gz", "f.md", "g.rs", "h.", "dir.x/plain"]
    assert one(spark, "p array<string>", paths, T.top_extensions(F.col("p")))[0] == ".py,.md,.gz"
    assert one(spark, "p array<string>", [], T.top_extensions(F.col("p")))[0] == ""


def test_truncation_counts_code_points(spark):
    assert len(one(spark, "d string", "😀" * 20_001, T.truncate(F.col("d")))[0]) == 20_000
    assert one(spark, "d string", "abc", T.truncate(F.col("d"), 2, "!"))[0] == "ab!"


def test_projects_and_aliases(spark):
    c = F.col("s")
    for project, want in (("org/repo/x", ("org", "repo/x")), ("repo", ("repo", "repo")), ("/repo", ("unknown", "repo")), ("org/", ("org", "org/"))):
        assert one(spark, "s string", project, T.owner_of(c), T.name_of(c)) == want
    df = spark.createDataFrame([("", None, "c")], "a string, b string, c string")
    assert df.select(T.first_of("a", "b", "c"), T.first_of("a", "b", default="d")).first() == ("c", "d")
    assert one(spark, "s string", " \n first \x85second", T.first_line(c))[0] == "first "


@pytest.mark.parametrize(
    "files,label",
    [([".github/workflows/docs/ci.md"], "ci"), (["tests/a.py", "src/b.py"], None), ([], None), (["src/readme.md"], "docs"), (["Tests/x.py"], None), (["a/CHANGELOG"], "docs"), (["sub/.circleci/x"], None), (["x/y_spec.rb", "e2e/q"], "test")],
)
def test_rules(spark, files, label):
    got = one(spark, "f array<string>", files, rules.classify(F.col("f")), rules.reason(F.col("f")))
    assert got[0] == label and (got[1] is None) == (label is None)
    if label:
        assert re.match(rf"all {len(files)} file", got[1])
