"""Secret scans: fixed patterns, and a likelihood ratio of two character Markov models.

Candidates are long runs of letters, digits and a few signs. Each is scored by first-order Markov models
of random strings and of ordinary identifiers; the mean log-likelihood ratio of its transitions decides.
Ordinary ones are made of the corpus's own words in the shapes that identifiers have: joined by signs, in
camel case, as paths, as constants, with numbers, versions and dates. Text in base 64 looks random to such
models and counts as a secret, whatever it encodes; an identifier in the standard form of UUIDs doesn't. All of it is built-in SQL functions: positions come
from the lengths of what lies between the matches.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from commitloom.functions.text import let
from commitloom.llm.common import sample

#: Kinds in the order that breaks ties, with pattern, group whose length counts, and least length.
BASE = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
]
#: What the models look at: runs of these characters of at least so many, with a digit and a letter or with both cases in them.
CANDIDATE, LEAST = r"[A-Za-z0-9+/_=-]{20,}", 20
ALPHABET = string.ascii_lowercase + string.ascii_uppercase + string.digits + "+/_=-"
#: Identifiers that many systems write for every row, and that grant nothing.
UUID = "^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"
#: A candidate is a secret from this mean log-likelihood ratio of a transition on.
MARGIN = 0.35
#: The share of each transition's probability that is its kind's (small letter to digit, and so on): no corpus has all pairs of letters that identifiers have.
BY_KIND = 0.4
#: Triples of words that ordinary strings are made of, at most, and numbers that random ones are.
SAMPLE, RANDOM = 4_000, 3_000
#: Documents whose words are taken for it, at most.
SAMPLE_DOCS = 1_000


#: Elements that running() goes through one after the other; its work grows little more than an array does.
STRIDE = 64


def running(steps: Column, joined) -> Column:
    """Of each element of an array of ints, what ``joined`` (of two ints, 0 being neutral) makes of all before it."""
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    walk = lambda x, of: F.aggregate(x, empty, lambda acc, y: F.struct(joined(acc["at"], of(y)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / STRIDE).cast("int")), lambda c: walk(F.slice(steps, c * STRIDE + 1, STRIDE), lambda y: y))
    whole = let(parts, lambda p: let(walk(p, lambda y: y["at"])["out"], lambda base: F.flatten(F.transform(p, lambda x, i: F.transform(x["out"], lambda v: joined(F.get(base, i), v))))))
    return F.when(F.size(steps) > 0, whole).otherwise(F.array().cast("array<int>"))


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, found>> of leftmost non-overlapping matches, in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    # each match's start: all gaps and matches before it, and its own gap
    starts = lambda x: running(F.transform(x["found"], lambda f, i: F.get(x["gap"], i) + F.length(f)), lambda a, b: a + b)
    spans = lambda x: let(
        starts(x),
        lambda before: F.transform(x["found"], lambda f, i: let(F.get(before, i) + F.get(x["gap"], i), lambda at: F.struct(at.alias("start"), (at + F.length(f)).alias("end"), f.alias("found")))),
    )
    return let(F.struct(found.alias("found"), gaps.alias("gap")), spans)


def spans_of(text: Column, pattern: str) -> Column:
    """The matches, found only in texts that have one."""
    return F.when(text.rlike(pattern), _matches(text, pattern)).otherwise(F.array().cast("array<struct<start:int,end:int,found:string>>"))


def _kind_spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    spans = spans_of(text, pattern)
    if group:
        spans = F.filter(spans, lambda x: F.length(F.regexp_extract(x["found"], pattern, group)) >= least)
    return F.transform(spans, lambda x: F.struct(x["start"], x["end"], F.lit(kind).alias("kind")))


def base_spans(text: Column) -> list[Column]:
    """One array of spans for each base kind, failing matches dropped."""
    return [_kind_spans(text, *rule) for rule in BASE]


def _codes(s: Column) -> Column:
    """Places in ALPHABET of a string's characters, 0 for others."""
    return F.transform(F.split(s, ""), lambda c: F.instr(F.lit(ALPHABET), c))


def transition_counts(samples: DataFrame) -> DataFrame:
    """(label, pair, n) of adjacent characters in ``samples`` (label, string); pair is a place in the square of the alphabet."""
    width = len(ALPHABET) + 1
    codes = samples.where(F.length("string") > 1).select("label", _codes(F.col("string")).alias("c"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.element_at("c", i) * width + F.element_at("c", i + 1))
    return codes.select("label", F.explode(pairs).alias("pair")).groupBy("label", "pair").agg(F.count("*").alias("n"))


def _kind_of(code: int) -> int:
    """Of a place in ALPHABET: small letters, capitals, digits, and signs with all else."""
    return min(code - 1, 62) // 26 if code else 3


def fit(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio (label 1, random, over label 0, ordinary) of each transition.

    A transition's probability is its share after its first character, mixed with BY_KIND of what its kind
    gives: the share of the second character's kind after the first one's, times the second's share of its
    kind. Every character and kind counts once more. Null and one-character strings teach nothing; without
    samples of a label all characters of a kind are as likely. At most the alphabet's square of counts for
    each label reaches the driver.
    """
    width = len(ALPHABET) + 1
    counts = [[0] * (width * width) for _ in (0, 1)]
    for label, pair, n in transition_counts(samples).toLocalIterator():
        counts[label][pair] += n
    kind = [_kind_of(i) for i in range(width)]
    logs = []
    for c in counts:
        after = [sum(c[a * width : (a + 1) * width]) for a in range(width)]
        ends = [1 + sum(c[b::width]) for b in range(width)]
        of_kind = [sum(n for n, k in zip(ends, kind, strict=True) if k == j) for j in range(4)]
        step = [[1] * 4 for _ in range(4)]
        for i, n in enumerate(c):
            step[kind[i // width]][kind[i % width]] += n
        logs.append([])
        for i, n in enumerate(c):
            a, b = divmod(i, width)
            rough = step[kind[a]][kind[b]] / sum(step[kind[a]]) * ends[b] / of_kind[kind[b]]
            logs[-1].append(math.log((1 - BY_KIND) * n / after[a] + BY_KIND * rough if after[a] else rough))
    return [b - a for a, b in zip(*logs, strict=True)]


def made_random(spark: SparkSession, n: int = RANDOM) -> DataFrame:
    """(label 1, string): digests of the numbers below n in hexadecimal of either case, base 64, letters only, base 36 and access-key shapes, of several lengths."""
    i = F.col("id").cast("string")
    base64 = F.regexp_replace(F.base64(F.unhex(F.sha2(i, 256))), "=", "")
    base36 = F.lower(F.concat(*[F.conv(F.substring(F.md5(i), 1 + 12 * k, 12), 16, 36) for k in (0, 1)], F.conv(F.substring(F.sha1(i), 1, 12), 16, 36)))
    cut = lambda s: F.substring(s, F.lit(1), (20 + F.col("id") % 24).cast("int"))
    kinds = F.array(cut(F.md5(i)), F.upper(F.substring(F.sha1(i), 1, 24)), base64, cut(F.translate(base64, "+/", "-_")), cut(F.regexp_replace(base64, "[+/]", "")), cut(F.regexp_replace(base64, "[+/0-9]", "")), base36, F.concat(F.lit("AKIA"), F.upper(F.substring(base36, 1, 16))))
    return spark.range(n).select(F.lit(1).alias("label"), F.explode(kinds).alias("string"))


def made_ordinary(words: DataFrame) -> DataFrame:
    """(label 0, string): identifiers of each row's three words (a, b, c) and numbers that their hash gives, in all usual shapes."""
    a, b, c = (F.lower(x) for x in ("a", "b", "c"))
    h = F.xxhash64("a", "b", "c")
    # the hash's own digits, one use each
    number = lambda at, size, low=0: (F.pmod(F.shiftright(h, at), F.lit(size)) + low).cast("string")
    two = lambda at, size, low=0: F.lpad(number(at, size, low), 2, "0")
    sign = F.element_at(F.array(F.lit("_"), F.lit("-"), F.lit("/")), (F.pmod(h, F.lit(3)) + 1).cast("int"))
    year, month, day = number(3, 40, 1990), two(9, 12, 1), two(14, 28, 1)
    clock = [two(19, 24), two(24, 60), two(30, 60)]
    shapes = F.array(
        F.concat(a, sign, F.col("b"), sign, F.initcap("c")),
        F.concat(a, F.initcap("b"), number(36, 10), F.initcap("c"), number(40, 100), F.initcap("a")),
        F.concat(F.initcap("a"), F.initcap("b"), F.initcap("c"), number(36, 1000)),
        F.concat(a, F.lit("/"), year, F.lit("/"), month, F.lit("/"), b, F.lit("-"), c, F.lit("-"), number(36, 100)),
        F.concat(year, F.lit("-"), month, F.lit("-"), day, F.lit("T"), F.concat_ws("-", *clock), F.lit("Z-"), a, F.lit("-"), b),
        F.concat(a, F.lit("_"), year, month, day, F.lit("_"), *clock, F.lit("_"), b),
        F.concat(a, number(36, 10), F.lit("_"), b, F.lit("_"), c, number(40, 10), F.lit("_"), F.lpad(number(44, 1000), 4, "0")),
        F.concat_ws("/", F.substring(a, 1, 3), b, c, F.concat(a, number(36, 100)), F.concat(F.initcap("b"), F.initcap("c"), number(44, 10))),
        F.concat(F.upper("a"), F.lit("_"), F.upper("b"), F.lit("_"), number(36, 10_000), F.lit("="), c, number(48, 100)),
        F.concat(F.upper("a"), number(36, 1000), F.lit("_"), F.upper(F.substring(b, 1, 3)), number(40, 100), F.lit("_"), F.upper("c"), F.lit("_"), F.upper(F.substring(a, 1, 1)), number(44, 100)),
        F.concat(a, F.initcap("b"), F.initcap("c"), F.initcap("a")),
        F.concat_ws("/", F.initcap("a"), b, F.concat(F.initcap("c"), F.initcap("b"))),
        F.concat(a, F.lit("-"), number(36, 20), F.lit("-"), number(40, 20), F.lit("-"), b, F.lit("-"), c, F.lit("_"), number(44, 256)),
    )
    return words.select(F.lit(0).alias("label"), F.explode(shapes).alias("string"))


def labelled_samples(docs: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """(label, string): made random strings, and ordinary ones of at most ``limit`` different triples of
    neighbouring words of SAMPLE_DOCS documents. Documents and triples are those with the smallest hashes, so the
    sample depends on the corpus and not on the order of its rows."""
    words = F.regexp_extract_all("text", F.lit(r"[A-Za-z]{2,16}"), F.lit(0))
    triples = let(words, lambda w: F.transform(F.sequence(F.lit(0), F.floor(F.size(w) / 3).cast("int")), lambda i: F.struct(F.get(w, 3 * i).alias("a"), F.get(w, 3 * i + 1).alias("b"), F.get(w, 3 * i + 2).alias("c"))))
    chosen = sample(docs.where(F.col("text").isNotNull()).select("doc_id", "text"), SAMPLE_DOCS).select(F.explode(triples).alias("x")).select("x.*").where("c is not null").distinct()
    return made_random(docs.sparkSession).union(made_ordinary(chosen.orderBy(F.xxhash64("a", "b", "c"), "a", "b", "c").limit(limit)))


def ratio_of(candidate: Column, model: Column) -> Column:
    """Mean log-likelihood ratio of a candidate's transitions."""
    width = len(ALPHABET) + 1
    start = F.struct(F.lit(0).alias("before"), F.lit(0.0).alias("total"))
    step = lambda acc, c: F.struct(
        c.alias("before"), (acc["total"] + F.when(acc["before"] > 0, F.element_at(model, acc["before"] * width + c + 1)).otherwise(F.lit(0.0))).alias("total")
    )
    return F.aggregate(_codes(candidate), start, step, lambda acc: acc["total"]) / (F.length(candidate) - 1)


def is_candidate(found: Column) -> Column:
    return (found.rlike("[0-9]") & found.rlike("[A-Za-z]") & ~found.rlike(UUID)) | (found.rlike("[a-z]") & found.rlike("[A-Z]") & ~found.rlike("[0-9]"))


def spans_column(text: Column, model: list[float], margin: float = MARGIN) -> tuple[dict[str, Column], Column]:
    """Columns of base spans by kind, and of them (by name) and ``text`` the column of all spans."""
    weights = F.from_json(F.lit("[" + ",".join(f"{x:.9g}" for x in model) + "]"), "array<double>")
    names = {f"_{kind}_spans": spans for (kind, *_), spans in zip(BASE, base_spans(text), strict=True)}
    mixed = F.filter(spans_of(text, CANDIDATE), lambda x: is_candidate(x["found"]) & (ratio_of(x["found"], weights) >= margin))
    known = F.concat(*map(F.col, names))
    added = F.filter(mixed, lambda x: ~F.exists(known, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])))
    kinds = F.concat(known, F.transform(added, lambda x: F.struct(x["start"], x["end"], F.lit("markov").alias("kind"))))
    order = F.create_map(*[x for i, (kind, *_) in enumerate([*BASE, ("markov",)]) for x in (F.lit(kind), F.lit(i))])
    ranked = F.array_sort(F.transform(kinds, lambda x: F.struct(x["start"], F.element_at(order, x["kind"]).alias("rank"), x["end"], x["kind"])))
    return names, F.transform(ranked, lambda x: F.struct(x["start"], x["end"], x["kind"]))


def scan_columns(docs: DataFrame, model: list[float], margin: float = MARGIN) -> DataFrame:
    """The columns of ``docs`` (text and any others but those added), null texts as empty, with spans."""
    docs = docs.select(*[c for c in docs.columns if c != "spans"]).withColumn("text", F.coalesce("text", F.lit("")))
    names, spans = spans_column(F.col("text"), model, margin)
    return docs.withColumns(names).withColumn("spans", spans).drop(*names)


def scan(docs: DataFrame, model: list[float], margin: float = MARGIN) -> DataFrame:
    """doc_id, text, spans (array of start, end, kind) of every document.

    ``docs`` needs doc_id and text; other columns are ignored. Null texts count as empty and have no
    spans. Spans are in code points with the end left out, by start and then kind as listed; ``markov``
    comes last and is added beside the base kinds only where no base span overlaps it. Repeated rows
    give repeated results; an empty table gives none.
    """
    return scan_columns(docs.select("doc_id", "text"), model, margin)


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span (by start), overlapping ones together, replaced by the mark."""
    ends = lambda: F.transform(spans, lambda x: x["end"])
    pieces = let(
        running(ends(), F.greatest),
        lambda before: F.transform(spans, lambda x, i: F.when(x["start"] >= F.get(before, i), F.concat(F.substring(text, F.get(before, i) + 1, x["start"] - F.get(before, i)), F.lit(mark))).otherwise(F.lit(""))),
    )
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(pieces, ""), F.substring(text, F.array_max(ends()) + 1, F.length(text))))


def model_of(docs: DataFrame) -> list[float]:
    return fit(labelled_samples(docs))
