"""Column functions over messages and diffs. All are built-in expressions; none runs Python on rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from commitloom.schema import LABELS, MAX_DIFF

#: Everything that ends a line in text mode: beyond line feeds and returns, the vertical tab, form feed,
#: file, group and record separators, next line, and the two Unicode separators.
LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"
_SPACE = r"[\s\x1C-\x1F]"
#: Fixed value: the header of a conventional commit.
CONVENTIONAL = r"^(" + "|".join(LABELS) + r")(?:\([^)]+\))?!?:[\s\x1C-\x1F][^\n]+"
#: Fixed value: lines of a diff that change without its content changing.
VOLATILE = r"(?U)^(index [0-9a-f]+\.\.[0-9a-f]+.*|@@ .*|commit [0-9a-f]+|Author:.*|Date:.*|[\s\x1C-\x1F]*)$"
#: Paths of a diff's new files, and of its headers.
NEW_PATH, HEADER_PATH = r"(?dm)^\+\+\+ b/(.+)$", r"(?dm)^diff --git a/.+ b/(.+)$"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once for each row, also where lambdas inside refer to it again and again."""
    return F.element_at(F.transform(F.array(value), use), 1)


def counted(items: Column) -> Column:
    """array<struct<term, n>> of an array of strings: its different ones in order and how often they occur, counted in the row. None for an empty array."""

    def runs(s):
        # of the sorted items, places (from 1) where a run of equal ones ends
        ends = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: ~F.get(s, i).eqNullSafe(F.get(s, i - 1)))
        pair = lambda e: F.transform(e, lambda i, k: F.struct(F.get(s, i - 1).alias("term"), (i - F.coalesce(F.get(e, k - 1), F.lit(0))).alias("n")))
        return F.when(F.size(s) > 0, let(ends, pair))

    return let(F.sort_array(items), runs)


def lines(text: Column) -> Column:
    return F.split(text, LINE_BREAK)


def strip(text: Column) -> Column:
    """Without white space at both ends, of any kind and not only blanks."""
    return F.regexp_replace(text, rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U){_SPACE}+$", "")


def first_of(*columns: Column | str, default: str | None = None) -> Column:
    """The first that is neither null nor empty."""
    some = [F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in columns]
    return F.coalesce(*some, F.lit(default))


def first_line(message: Column) -> Column:
    """First line of the stripped message; null if nothing is left."""
    return F.nullif(F.element_at(lines(strip(message)), 1), F.lit(""))


def conventional_label(subject: Column) -> Column:
    """The type of a conventional header; null for any other subject."""
    return F.nullif(F.regexp_extract(subject, CONVENTIONAL, 1), F.lit(""))


def owner_of(project: Column, default: str = "unknown") -> Column:
    """What stands before the first slash."""
    return F.coalesce(F.nullif(F.substring_index(project, "/", 1), F.lit("")), F.lit(default))


def name_of(project: Column) -> Column:
    """What stands after the first slash, or all of it if that is empty."""
    at = F.instr(project, "/")
    return F.coalesce(F.when(at > 0, F.nullif(F.substr(project, at + 1), F.lit(""))), project)


def truncate(diff: Column, limit: int = MAX_DIFF, mark: str = "") -> Column:
    """At most ``limit`` code points, then the mark where something was cut."""
    return F.when(F.length(diff) > limit, F.concat(F.substring(diff, 1, limit), F.lit(mark))).otherwise(diff)


def added_lines(diff: Column) -> Column:
    return F.filter(lines(diff), lambda x: x.startswith("+") & ~x.startswith("+++"))


def deleted_lines(diff: Column) -> Column:
    return F.filter(lines(diff), lambda x: x.startswith("-") & ~x.startswith("---"))


def line_counts(diff: Column) -> Column:
    """struct<added, deleted>: how many lines a diff adds and deletes, cut once."""
    count = lambda x, sign: F.size(F.filter(x, lambda l: l.startswith(sign) & ~l.startswith(3 * sign))).cast("long")  # noqa: E731, E741
    return let(lines(diff), lambda x: F.struct(count(x, "+").alias("added"), count(x, "-").alias("deleted")))


def not_blank(text: Column) -> Column:
    """Whether anything but white space is in it."""
    return text.rlike(r"(?U)[^\s\x1c-\x1f]")


def normalize_diff(diff: Column) -> Column:
    """Without volatile and blank lines, and without white space at the ends of the others."""
    return F.array_join(F.transform(F.filter(lines(diff), lambda x: ~x.rlike(VOLATILE)), rstrip), "\n")


def rebuild_diff(mods: Column) -> Column:
    """One diff of an array of modified files, a missing path being /dev/null."""
    path = lambda p: first_of(p, default="/dev/null")
    part = lambda m: F.concat(
        F.lit("diff --git a/"), path(m["old_path"]), F.lit(" b/"), path(m["new_path"]), F.lit("\n--- a/"), path(m["old_path"]),
        F.lit("\n+++ b/"), path(m["new_path"]), F.lit("\n"), F.coalesce(m["diff"], F.lit("")),
    )
    return F.array_join(F.transform(mods, part), "\n")


def mod_paths(mods: Column) -> Column:
    """The new path of each modified file, the old one of deleted files."""
    null = F.lit("/dev/null")
    return F.transform(mods, lambda m: F.coalesce(F.nullif(first_of(m["new_path"], default="/dev/null"), null), first_of(m["old_path"], default="/dev/null")))


def changed_paths(diff: Column) -> Column:
    """Paths of the new files; of the headers where there is none."""
    new = F.regexp_extract_all(diff, F.lit(NEW_PATH), F.lit(1))
    return F.when(F.size(new) > 0, new).otherwise(F.regexp_extract_all(diff, F.lit(HEADER_PATH), F.lit(1)))


def suffix(path: Column) -> Column:
    """The last extension with its dot, in lower case; empty for dot files, and for a name that ends in a dot."""
    name = F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)
    return F.lower(F.regexp_extract(name, r"(?s)^.+(\.[^.]+)$", 1))


def top_extensions(paths: Column, k: int = 3) -> Column:
    """The k most common extensions, comma-joined, ties in order of appearance.

    Works inside a row: a commit's paths are few, so counting them needs no shuffle.
    """

    def most_common(exts: Column) -> Column:
        one = lambda e: F.struct((-F.size(F.filter(exts, lambda x: x == e))).alias("n"), F.array_position(exts, e).alias("at"), e.alias("e"))
        ranked = F.array_sort(F.transform(F.array_distinct(exts), one))
        return F.array_join(F.transform(F.slice(ranked, 1, k), lambda x: x["e"]), ",")

    return let(F.filter(F.transform(paths, suffix), lambda e: e != ""), most_common)
