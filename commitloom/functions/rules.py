"""Path rules: a change is classified where all its files fit one category."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a path of each category looks like.
CI = [
    r"^\.github/(workflows|actions)/", r"^\.gitlab-ci\.ya?ml$", r"^\.circleci/", r"^azure-pipelines.*\.ya?ml$", r"^Jenkinsfile$", r"^\.travis\.ya?ml$",
    r"^\.drone\.ya?ml$", r"^\.buildkite/", r"^buildkite\.ya?ml$", r"^appveyor\.ya?ml$", r"^codecov\.ya?ml$", r"^\.pre-commit-config\.ya?ml$",
]
DOCS = [
    r"\.(md|mdx|rst|adoc)$", r"(^|/)(README|CHANGELOG|CONTRIBUTING|AUTHORS|LICENSE|NOTICE|CODE_OF_CONDUCT|SECURITY|MAINTAINERS)(\.[^/]*)?$",
    r"(^|/)docs?/", r"(^|/)documentation/",
]
TESTS = [
    r"(^|/)tests?/", r"(^|/)__tests__/", r"(^|/)spec/", r"(^|/)e2e/", r"(^|/)test_[^/]+\.py$", r"_test\.(py|go|rb)$",
    r"\.(test|spec)\.(ts|tsx|js|jsx|mjs|cjs)$", r"Test\.java$", r"Tests?\.cs$", r"_spec\.rb$",
]

#: In order of priority: label, pattern, and what its files are.
RULES = [
    ("ci", "|".join(CI), "under CI config paths"),
    ("docs", "(?i)" + "|".join(DOCS), "are documentation"),
    ("test", "|".join(TESTS), "are test files"),
]


def all_match(files: Column, pattern: str) -> Column:
    """Whether there are files and all of them fit."""
    return (F.size(files) > 0) & F.forall(files, lambda f: f.rlike(pattern))


def classify(files: Column) -> Column:
    """The first category that all files fit; null for mixed changes and for none."""
    out = F.lit(None).cast("string")
    for label, pattern, _ in reversed(RULES):
        out = F.when(all_match(files, pattern), F.lit(label)).otherwise(out)
    return out


def reason(files: Column) -> Column:
    out = F.lit(None).cast("string")
    for label, _, what in RULES:
        out = F.when(classify(files) == label, F.concat(F.lit("all "), F.size(files).cast("string"), F.lit(f" file(s) {what}"))).otherwise(out)
    return out
