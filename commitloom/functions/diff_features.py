"""Features of one diff, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from commitloom.functions import text as T

#: An extension at the end of a new file's line, and of a header.
NEW_EXT, HEADER_EXT = r"(?dm)^\+\+\+ b/.+(\.[a-zA-Z0-9]+)$", r"(?dm)^diff --git a/.+ b/.+(\.[a-zA-Z0-9]+)$"
#: Runs of letters, digits and underscores of any script.
WORD = r"[\p{L}\p{N}_]+"
#: Two such characters at least: the tokens of the vectorizers.
TOKEN = r"[\p{L}\p{N}_]{2,}"


def path_tokens(diff: Column) -> Column:
    """Different parts of the changed paths with more than two characters, in lower case and in order."""
    parts = F.flatten(F.transform(T.changed_paths(diff), lambda p: F.split(p, r"[/\-_.]")))
    return F.array_sort(F.array_distinct(F.transform(F.filter(parts, lambda p: F.length(p) > 2), F.lower)))


def extensions(diff: Column) -> Column:
    """Different extensions of the changed files, without dot, in lower case and in order."""
    new = F.regexp_extract_all(diff, F.lit(NEW_EXT), F.lit(1))
    some = F.when(F.size(new) > 0, new).otherwise(F.regexp_extract_all(diff, F.lit(HEADER_EXT), F.lit(1)))
    return F.array_sort(F.array_distinct(F.transform(some, lambda e: F.lower(F.substring(e, 2, 1 << 20)))))


def tokens(text: Column, pattern: str = TOKEN) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def change_jaccard(diff: Column) -> Column:
    """How alike the words of added and of deleted lines are; 0 without either. Header-like lines don't count."""
    words = lambda ls: F.array_distinct(tokens(F.array_join(F.transform(ls, lambda x: F.substring(x, 2, 1 << 30)), "\n"), WORD))
    sides = F.struct(words(T.added_lines(diff)).alias("a"), words(T.deleted_lines(diff)).alias("d"))

    def likeness(both: Column) -> Column:
        every = F.size(F.array_union(both["a"], both["d"]))
        return F.when(every > 0, F.size(F.array_intersect(both["a"], both["d"])) / every).otherwise(F.lit(0.0))

    return T.let(sides, likeness)


def add_del_ratio(additions: Column, deletions: Column) -> Column:
    return additions / (deletions + 1)


def number(column: Column) -> Column:
    """As a double; what is none counts as 0."""
    return F.coalesce(column.try_cast("double"), F.lit(0.0))
