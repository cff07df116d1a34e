import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from commitloom.llm import fingerprint as fp


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=200), st.sets(st.integers(0, 2**64 - 1), max_size=200), st.sets(st.integers(0, 2**64 - 1), max_size=50))
def test_differences_equal_sets(a, b, shared):
    a, b = a | shared, b | shared
    arrays = [np.array(sorted(x), np.uint64) for x in (a, b)]
    (found,) = fp.differences([arrays[0]], [arrays[1]])
    assert sorted(found) == sorted([(x, 1) for x in a - b] + [(x, -1) for x in b - a])
    assert fp.likeness(*[[x] for x in arrays]) == [len(a & b) / len(a | b) if a | b else 1.0]


def test_paragraphs_cover_the_text():
    r = random.Random(1)
    for _ in range(200):
        text = "".join(r.choices(["word", " ", "\n", "é😀", "  ", "\t", "longer"], k=r.randint(0, 60)))
        assert "".join(fp.paragraphs(text)) == text.replace("\n", "") and all(fp.paragraphs(text))


def brute(rows):
    groups = sorted(rows, key=lambda r: ((r[0] is not None), r[0] or 0, r[1] or ""))[::-1]
    out = []
    for i, (doc_id, text) in enumerate(groups):
        text, after = text or "", groups[(i + 1) % len(groups)][1] or ""
        k = len(text) // 3
        edit = text[: len(text) - k] + after[:k]
        like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        own, new, nxt = (set(fp.digests(t).tolist()) for t in (text, edit, after))
        out.append((doc_id, len(text), hashlib.sha256(edit.encode()).hexdigest(), like(own, new), like(own, nxt)))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, part string, fingerprint string")
    return fp.compare_versions(df.repartition(3)).collect()


def test_versions_equal_brute_force(spark):
    r = random.Random(2)
    text = lambda: "".join(r.choices(["the ", "Haus ", "é", "😀 ", "\n", "x y ", "zebra. "], k=r.randint(0, 150)))
    rows = [(i * 7, text()) for i in range(120)] + [(1000, None), (1001, ""), (1002, "word " * 40_000), (1003, "same"), (1004, "same"), (1004, "other"), (1004, "other"), (None, "null id"), (2, "ab")]
    got = run(spark, rows)
    assert sorted([(g.doc_id, g.n_chars, g.edited_sha256, g.near_edited, g.near_next) for g in got], key=str) == brute(rows)
    by_text = {}
    for g, (doc_id, text_) in ((g, t) for g in got for t in rows if t[0] == g.doc_id and g.doc_id in (1003, 1004) and t[1] == "same"):
        by_text.setdefault(text_, set()).add(g.fingerprint)
    assert {g.fingerprint for g in got if g.doc_id == 1003} <= {g.fingerprint for g in got if g.doc_id == 1004}


def test_small_tables(spark):
    assert run(spark, [(5, "only one\nhere")])[0].near_next == 1.0
    assert len(run(spark, [(1, None), (2, "")])) == 2
    assert len(run(spark, [(None, "a"), (None, "b")])) == 2
    df = spark.createDataFrame([], "doc_id long, text string")
    assert fp.compare_versions(df).count() == 0


def test_equal_fingerprints_and_edits_are_near():
    text = "\n".join(f"line {i} of a longer text with some words in it" for i in range(60))
    a, b = fp.digests(text), fp.digests(fp.edited(text, "something else entirely " * 200))
    assert fp.written([a]) == fp.written([fp.digests(text)]) and fp.likeness([a], [b])[0] > 0.3


def test_ranges_and_their_partitions(spark):
    for n in (1, 2, 5, 37):
        bounds = [3 * i for i in range(n)]
        got = spark.range(-2, 3 * n + 2).select("id", fp.below(F.col("id"), bounds).alias("b")).collect()
        assert all(r.b == sum(x < r.id for x in bounds) for r in got)
        keys = fp.dealing_keys(spark, n)
        spread = spark.createDataFrame([(k,) for k in keys], "part int").repartition(n, "part").select("part", F.spark_partition_id().alias("p")).collect()
        assert sorted(r.p for r in spread) == list(range(n)) and all(keys[r.p] == r.part for r in spread)
    assert spark.range(3).select(fp.below(F.col("id"), []).alias("b")).distinct().collect()[0].b == 0
