"""Elements of large JSON arrays in files, read in parallel.

A file is read in splits, in pieces that end with a closing brace, and pieces are put together to chunks. What a
chunk's text means depends on whether it begins inside a string and how deep: for each chunk its change of both is
counted for either beginning, and running sums over the chunks of a file, which are small rows, tell how each
begins. Then every chunk cuts out its elements by itself, and only those that lie across chunks are put together.
An element is one row in the end, and so is a file without closing braces.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from commitloom import scratch

#: Characters of a chunk, about (one piece at least).
CHUNK = 1_000_000

_ESCAPED = re.compile(r"\\.", re.S)
_STRING = re.compile(r'"[^"]*(?:"|$)')
_REST = re.compile(r'(?:[^"\\]|\\.)*(?:"|$)', re.S)
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*(?:"|$)|[\[\]{},]', re.S)
_DATA = re.compile(r'"data"\s*:\s*\[')


def _depth(text: str) -> int:
    """How much deeper a text without escapes ends than it begins, if it begins outside of strings."""
    bare = _STRING.sub("", text)
    return bare.count("{") + bare.count("[") - bare.count("}") - bare.count("]")


def _chunks(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, block, id (in order), text, size (of the file), quotes (odd or even), and the changes of depth for both beginnings."""
    pieces = spark.read.option("lineSep", "}").text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("_metadata.file_size").alias("size"), "value"
    )
    names = ["path", "block", "id", "text", "size", "bytes", "quotes", "from_outside", "from_inside"]

    def row(path, block, id_, size, text):
        plain = _ESCAPED.sub("", text)
        first = plain.find('"')
        inside = plain[first + 1 :] if first >= 0 else ""
        values = (path, block, id_, text, size, len(text.encode()), plain.count('"') % 2, _depth(plain), _depth(inside))
        return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=names)

    def run(batches):
        for batch in batches:
            now, held, n = None, [], 0
            for path, block, id_, size, value in zip(*(batch.column(c).to_pylist() for c in ("path", "block", "id", "size", "value")), strict=True):
                if held and (n >= CHUNK or (path, block) != now[:2]):
                    yield row(*now, "".join(held))
                    held, n = [], 0
                if not held:
                    now = path, block, id_, size
                held.append(value + "}")
                n += len(value) + 1
            if held:
                yield row(*now, "".join(held))

    return pieces.mapInArrow(run, "path string, block long, id long, text string, size long, bytes long, quotes long, from_outside long, from_inside long")


def _placed(chunks: DataFrame) -> DataFrame:
    """path, block, id, inside (a string), depth, where each chunk begins, and spare: whether the file's last brace is none of its own."""
    order = Window.partitionBy("path").orderBy("block", "id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = chunks.select("path", "block", "id", "size", "bytes", "quotes", "from_outside", "from_inside").withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    rows = rows.withColumn("change", F.when(F.col("inside") == 1, F.col("from_inside")).otherwise(F.col("from_outside")))
    spare = F.sum("bytes").over(Window.partitionBy("path")) - F.col("size")
    spare = F.when(spare < 0, spare + 3).otherwise(spare)  # a mark of the byte order, which readers leave out
    return rows.select("path", "block", "id", (F.col("inside") == 1).alias("inside"), F.coalesce(F.sum("change").over(before), F.lit(0)).alias("depth"), spare.alias("spare"))


def _walk(text: str, inside: bool, depth: int):
    """(place, token, depth before it) of the brackets, commas and strings of a chunk; a string that began earlier is left out."""
    at = _REST.match(text).end() if inside else 0
    for m in _TOKEN.finditer(text, at):
        token = m[0][0]
        yield m.start(), token, depth
        depth += 1 if token in "[{" else -1 if token in "]}" else 0


def _of_data(placed: DataFrame) -> DataFrame:
    """path, block, id, opened, closed: how often each chunk of an object begins and ends the array under ``data``."""

    def run(batches):
        for batch in batches:
            opened, closed = [], []
            for text, inside, depth in zip(*(batch.column(c).to_pylist() for c in ("text", "inside", "depth")), strict=True):
                marks = [(place, 1) for place, token, d in _walk(text, inside, depth) if d == 1 and token == '"' and _DATA.match(text, place)]
                opened.append(len(marks))
                closed.append(sum(token == "]" and d == 2 for _, token, d in _walk(text, inside, depth)))
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("block"), batch.column("id"), pa.array(opened, pa.int64()), pa.array(closed, pa.int64())], names=["path", "block", "id", "opened", "closed"])

    return placed.mapInArrow(run, "path string, block long, id long, opened long, closed long")


def _pieces_of(text: str, inside: bool, depth: int, level: int, open_: bool) -> tuple[list[str], int, int, int]:
    """(texts between the commas of the array at ``level``, characters that aren't blank after the document's end, documents, arrays) that a chunk has or begins.

    ``open_``: whether the chunk begins in the array. The first text goes on from the chunk before, the last may go on
    in the next; the array's own brackets are left out.
    """
    parts, start, after, documents, arrays = [""], 0 if open_ else None, 0, 0, 0
    end = 0 if depth == 0 and not inside else None
    for place, token, d in _walk(text, inside, depth):
        if start is None:
            if token == "[" and level == 1 and d == 0 or token == '"' and level == 2 and d == 1 and (m := _DATA.match(text, place)):
                start = place + 1 if level == 1 else m.end()
                arrays += 1
        elif start is not None and d == level and token == "," and place >= start:
            parts[-1] += text[start:place]
            parts.append("")
            start = place + 1
        elif d == level and token == "]" and place >= start:
            parts[-1] += text[start:place]
            start = None
        if token in "]}" and d == 1:
            end = place + 1
        elif token in "[{" and d == 0:
            end, documents = None, documents + 1
    if start is not None:
        parts[-1] += text[start:]
    if end is not None:
        after = len("".join(text[end:].split()))
    return parts, after, documents, arrays


def elements(spark: SparkSession, arrays: list[str], objects: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(path, line, value) of the elements of files that are arrays, or objects with an array under ``data``; and (path, whole) of the files.

    line counts from 1; value is the element's text. ``whole`` tells whether a file is one valid document with
    such an array, as far as its brackets, what follows its end, and its elements go: where it is not, its
    elements mean nothing. An object's first array under ``data`` counts.
    """
    chunks, _ = scratch.keep(_chunks(spark, [*arrays, *objects]))
    states, _ = scratch.keep(_placed(chunks))
    placed = chunks.select("path", "block", "id", "text").join(states, ["path", "block", "id"])
    first = F.ltrim(F.regexp_replace("text", "^﻿", "")).startswith("{")
    kinds = chunks.join(chunks.groupBy("path").agg(F.min(F.struct("block", "id")).alias("x")).select("path", "x.*"), ["path", "block", "id"]).select("path", F.when(first, 2).otherwise(1).alias("level"))
    key = ["path", "block", "id"]
    if objects:
        marks = _of_data(placed.join(kinds.where("level = 2"), "path"))
        before = Window.partitionBy("path").orderBy("block", "id").rowsBetween(Window.unboundedPreceding, -1)
        marks = marks.select(*key, (F.coalesce(F.sum("opened").over(before), F.lit(0)) > 0).alias("opened"))
        placed = placed.join(kinds, "path").join(marks, key, "left").withColumn("open", F.when(F.col("level") == 1, F.col("depth") >= 1).otherwise(F.coalesce("opened", F.lit(False)) & (F.col("depth") >= 2)))
    else:
        placed = placed.join(kinds, "path").withColumn("open", F.col("depth") >= 1)

    def run(batches):
        for batch in batches:
            for path, block, id_, text, inside, depth, level, open_ in zip(*(batch.column(c).to_pylist() for c in (*key, "text", "inside", "depth", "level", "open")), strict=True):
                text = text.removeprefix("﻿")
                parts, *counted = _pieces_of(text, inside, depth, level, open_)
                n = len(parts)
                columns = [[path] * n, [block] * n, [id_] * n, list(range(n)), [n - 1] * n, parts, *([x] * n for x in counted)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[*key, "k", "commas", "value", "after", "documents", "arrays"])

    cut, _ = scratch.keep(placed.mapInArrow(run, "path string, block long, id long, k long, commas long, value string, after long, documents long, arrays long"))
    counts = cut.where("k = 0").select(*key, "commas", "after", "documents", "arrays")
    before = Window.partitionBy("path").orderBy("block", "id").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*key, F.coalesce(F.sum("commas").over(before), F.lit(0)).alias("base"))
    numbered = cut.join(base, key).select("path", "block", "id", (F.col("base") + F.col("k") + 1).alias("line"), "value", ((F.col("k") > 0) & (F.col("k") < F.col("commas"))).alias("alone"))
    across = numbered.where("NOT alone").groupBy("path", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "id", "value"))), lambda x: x["value"]), "").alias("value"))
    found, _ = scratch.keep(numbered.where("alone").select("path", "line", "value").union(across).select("path", "line", F.trim("value", F.lit(" \r\n\t")).alias("value")))
    ends = chunks.join(states, key).groupBy("path").agg(
        F.max_by(F.struct((F.col("depth") + F.when(F.col("inside"), F.col("from_inside")).otherwise(F.col("from_outside"))).alias("depth"), ((F.col("inside").cast("int") + F.col("quotes")) % 2).alias("inside"), "spare"), F.struct("block", "id")).alias("e"),
    )
    after = counts.groupBy("path").agg(*[F.sum(c).alias(c) for c in ("after", "documents", "arrays")])
    # one element that is blank is none: an empty array
    several = found.groupBy("path").agg(F.count("*").alias("n"), F.count_if(F.expr("try_parse_json(value) IS NULL")).alias("broken"), F.count_if(F.col("value") == "").alias("blank"))
    balanced = (F.col("e.depth") == -F.col("e.spare")) & (F.col("e.inside") == 0) & (F.col("after") == F.col("e.spare")) & (F.col("documents") == 1) & (F.col("arrays") > 0)
    sound = (F.col("broken") == 0) | (F.col("n") == 1) & (F.col("blank") == 1)
    whole = ends.join(after, "path").join(several, "path").select("path", (balanced & sound).alias("whole"))
    return found.where("value <> ''").select("path", "line", "value"), whole
