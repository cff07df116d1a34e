"""JSON records in files: lines, arrays, and objects with an array under ``data``; and what is written from them."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commitloom.sources import json_arrays


def expand_inputs(spark: SparkSession, items: list[str]) -> list[str]:
    """Paths in order: of a folder its *.jsonl and then its *.json files, each sorted; missing ones are warned of and skipped."""
    out = []
    for item in items:
        at = spark._jvm.org.apache.hadoop.fs.Path(item)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            warnings.warn(f"skipping missing input: {item}", stacklevel=2)
        elif fs.getFileStatus(at).isDirectory():
            names = sorted(s.getPath().toString() for s in fs.listStatus(at))
            out += [n for n in names if n.endswith(".jsonl")] + [n for n in names if n.endswith(".json")]
        else:
            out.append(item)
    return out


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """path, line (from 1, as in the file), value of every line of files.

    Rows of a block follow each other, so a line's number is its place in its block and the lines of the
    blocks before it: one small table of blocks, and no sort of lines.
    """
    rows = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    blocks = rows.groupBy("path", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = blocks.select("path", "block", "first", before.alias("before"))
    return rows.join(F.broadcast(before), ["path", "block"]).select("path", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line"), "value")


def _parsed(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows whose value is one JSON object of the schema; blank and broken ones are dropped."""
    wide = T.StructType([*schema.fields, T.StructField("_broken", T.StringType())])
    text = F.trim("value")
    kept = rows.where((text != "") & text.startswith("{")).withColumn("_row", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}))
    return kept.where(F.col("_row").isNotNull() & F.col("_row._broken").isNull()).select(*[c for c in rows.columns if c != "value"], *[F.col("_row")[f.name].alias(f.name) for f in schema.fields])


#: Suffixes of files that are read as a whole, as their bytes aren't their text.
_PACKED = (".gz", ".bz2", ".deflate", ".zst", ".lz4", ".snappy", ".xz")


def _head(spark: SparkSession, path: str) -> str:
    """The first character of a file that isn't blank, or none."""
    if path.endswith(_PACKED):
        return (spark.read.text(path).where(F.trim("value") != "").select(F.substring(F.ltrim("value"), 1, 1)).first() or [""])[0]
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        while some := bytes(stream.readNBytes(4096)):
            if text := some.removeprefix(b"\xef\xbb\xbf").strip():
                return chr(text[0])
    finally:
        stream.close()
    return ""


def _name(spark: SparkSession, path: str) -> str:
    """A file's path as rows that are read from it have it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return _plain(at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri().toString())


def _plain(uri: str) -> str:
    return "file:/" + uri[5:].lstrip("/") if uri.startswith("file:") else uri


def _packed_elements(spark: SparkSession, path: str, head: str) -> DataFrame | None:
    """line, value of a packed file's elements; None if it isn't whole."""
    inner = F.from_json("value", "array<string>") if head == "[" else F.from_json("value", "struct<data: array<string>>")["data"]
    elements = spark.read.text(path, wholetext=True).select(inner.alias("e"))
    if not elements.where("e is not null").limit(1).count():
        return None
    return elements.select(F.posexplode("e").alias("pos", "value")).select((F.col("pos") + 1).cast("long").alias("line"), "value")


def read_files(spark: SparkSession, paths: list[str], schema: T.StructType, strict: bool = False) -> DataFrame:
    """path, line and the schema's columns of files' records.

    A file that begins with [ is an array, one whose only object has ``data`` is that array; elements are
    numbered from 1 and those that are no objects are skipped. An array that can't be parsed is read as
    lines. ``strict`` raises where a file without the suffix .jsonl is neither. All arrays are read together, in
    parallel, and so are all files of lines; of each file only its first character and whether it is whole
    reach the driver. A file that is named twice is read once.
    """
    different = {_name(spark, p): p for p in reversed(paths)}
    heads = {p: _head(spark, p) for p in reversed(different.values())}
    whole, parts = set(), []
    some = {p: h for p, h in heads.items() if h == "[" or h == "{" and not p.endswith(".jsonl")}
    for p in [p for p in some if p.endswith(_PACKED)]:
        if (found := _packed_elements(spark, p, some.pop(p))) is not None:
            whole.add(p)
            parts.append(found.select(F.lit(_name(spark, p)).alias("path"), "line", "value"))
    if some:
        found, sound = json_arrays.elements(spark, [p for p, h in some.items() if h == "["], [p for p, h in some.items() if h == "{"])
        sound = {_plain(r["path"]) for r in sound.where("whole").select("path").collect()}
        whole |= {p for p in some if _name(spark, p) in sound}
        parts.append(found)
    if strict and (neither := [p for p in heads if p not in whole and not p.endswith(".jsonl")]):
        raise ValueError(f"expected an array, or an object with an array under data: {', '.join(neither)}")
    lines = [p for p in heads if p not in whole]
    plain = lambda df: df.withColumn("path", F.regexp_replace("path", "^file:/+", "file:/"))
    names = [_name(spark, p) for p in whole]
    kept = [plain(x).join(F.broadcast(spark.createDataFrame([(n,) for n in names], "path string")), "path", "left_semi") for x in parts if names]
    if lines:
        kept.append(plain(read_lines(spark, *lines)))
    out = spark.createDataFrame([], "path string, line long, value string")
    for x in kept:
        out = out.union(x.select("path", "line", "value"))
    return _parsed(out, schema)


def read_file(spark: SparkSession, path: str, schema: T.StructType, strict: bool = False) -> DataFrame:
    """line and the schema's columns of one file's records: see ``read_files``."""
    return read_files(spark, [path], schema, strict).drop("path")


def read_records(spark: SparkSession, items: list[str], schema: T.StructType) -> DataFrame:
    """seq and the schema's columns of all inputs: seq orders by input, then by line. An input that is named twice counts twice."""
    paths = expand_inputs(spark, items)
    if not paths:
        return spark.createDataFrame([], T.StructType([T.StructField("seq", T.LongType()), *schema.fields]))
    places = spark.createDataFrame([(_name(spark, p), i) for i, p in enumerate(paths)], "path string, _i long")
    rows = read_files(spark, paths, schema).join(F.broadcast(places), "path")
    return rows.select((F.col("line") + F.shiftleft("_i", 40)).alias("seq"), *schema.fieldNames())


def write_jsonl(df: DataFrame, path: str, append: bool = False, order: str | None = None) -> None:
    """JSON lines, text as it is and nulls written out. ``order`` sorts and leaves its column out; files follow each other in it."""
    rows = df.orderBy(order).drop(order) if order else df
    rows.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def write_duplicates(report: DataFrame, path: str) -> None:
    """key, value, count, line_numbers as CSV: keys as they were asked for, most frequent values first; a value's pieces, if it has some, follow each other."""
    pieces = ["piece"] if "piece" in report.columns else []
    rows = report.orderBy("key_ord", F.desc("count"), "value", *pieces).select("key", "value", "count", "line_numbers")
    rows.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def labels_text(df: DataFrame, label: str = "label") -> str:
    """Sorted different labels, a line each, no line feed at the end."""
    return "\n".join(r[0] for r in df.select(label).where(F.col(label).isNotNull()).distinct().orderBy(label).collect())


def write_labels(df: DataFrame, path: str, label: str = "label") -> None:
    """``labels_text`` as one file, in any store that Spark writes to."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(labels_text(df, label).encode()))
    out.close()
