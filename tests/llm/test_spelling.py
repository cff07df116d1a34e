import random
import re
import zlib
from collections import Counter

from commitloom.llm import queries, spelling

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(rows, every):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if every and doc_id is not None and h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def are_near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, every=97):
    vocab = words_of(rows, every)
    form, near = {}, {}
    for w in vocab:
        others = [v for v in vocab if are_near(w, v)]
        near[w] = len(others)
        best = min(others, key=lambda v: (-vocab[v], v), default=None)
        form[w] = best if best is not None and vocab[best] >= 2 * vocab[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n, near[w], vocab[form[w]] if form[w] else -1) for w, n in vocab.items())


def run(spark, rows, every=97):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, word string, n int")
    found = spelling.variants(docs, every).collect()
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in found)


def test_variants_equal_brute_force(spark):
    r = random.Random(5)
    stems = ["abcde", "abcdé", "aabbcc", "zzzzzz", "ÀÉÏõü", "wordword", "÷×÷×÷"]

    def slip(w):
        at, c = r.randrange(len(w)), r.choice("abzéÿ")
        return r.choice([w[:at] + c + w[at:], w[:at] + w[at + 1 :], w[:at] + c + w[at + 1 :]])

    rows = []
    for d in range(60):
        words = []
        for _ in range(60):
            w = r.choice(stems)
            while r.random() < 0.5:
                w = slip(w) or "x"
            words.append(w.upper() if r.random() < 0.2 else w)
        rows.append((d, r.choice([" ", "\n", "5", ". "]).join(words)))
    rows += [(100, None), (101, ""), (None, "abcde abcde"), (7, "abcde"), (7, "abcde"), (102, "123 _ ß_ ñandu"), (103, "q" * 30_000), (103, "Q" * 30_000), (103, "q" * 30_000)][:-3]
    got = run(spark, rows)
    assert got == brute(rows) and len(got) > 60
    assert any(r[4] > 1 for r in got) and len({r[2] for r in got}) < len(got)


def test_forms_lead_over_several_steps_to_a_root(spark):
    words = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "abbbb": 48, "bbbbb": 96, "bbbb": 500, "bbbbbb": 95, "ccccc": 3, "ccccd": 5, "tie-s": 9, "ttttt": 3, "ttttu": 6, "ttttv": 6}
    rows = [(i, " ".join(w for w, n in words.items() if i < n)) for i in range(100)]
    got = {r[0]: r for r in run(spark, rows, None)}
    assert [got[w][2] for w in ("aaaaa", "aaaab", "abbbb", "bbbbb")] == ["bbbbb"] * 4
    assert got["aaaaa"][1:] == ("aaaab", "bbbbb", 3, 1, 6) and got["ccccc"][1] == "" and got["bbbbbb"][1] == ""
    assert got["ttttt"][1] == "ttttu" and got["ttttu"][1] == "" and "bbbb" not in got
    assert sorted(got.values()) == brute(rows, None)


def test_empty_table(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, "abcde abcde")]) == []


def test_query_equals_brute_force(spark):
    data = "/root/testdata/sf0.001"
    got = queries.op12_spelling_variants(spark, data)
    assert got.columns[:6] == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    found = sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in got.collect())
    assert found == brute(rows) and len(found) > 500
