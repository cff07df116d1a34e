import base64
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from commitloom.llm import queries, secrets

ASSIGN = re.compile(r"""(?a)(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
BITS = ["password", "PassWd: ", "secret=", "token = \"", "api_key", "APIKEY:'", " ", "=", ":", "abcd", "abcdefgh12345", "AKIA", "AKIAABCDEFGHIJKL", "XYZ", "0123456789abcdef" * 2, "deadbeef", "é", "😀", "\n", "zz", "ſecret=abcdefghi", "toKen=12345678"]


def base(text):
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(found)]


def texts():
    r = random.Random(3)
    return [None, "", "x" * 5000, "token=secret= abcdefghij", "a" * 40 + " " + "b" * 200_000] + ["".join(r.choices(BITS, k=r.randint(1, 25))) for _ in range(300)]


def test_base_spans_equal_brute_force(spark, tmp_path):
    rows = [(i, t, "x", "y") for i, t in enumerate(texts())] + [(3, "again", None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, spans string, h string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [r for r in queries.op8_secret_scans(spark, str(tmp_path)).collect()]
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id == 3:
            continue
        want = base(rows[r.doc_id][1] or "")
        mine = [x for x in r.spans.split(",") if x and not x.startswith("markov")]
        assert mine == want and r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x.startswith(k) for x in want) for k in ("assign", "access", "hex"))


@pytest.fixture(scope="module")
def model(spark):
    return secrets.model_of(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def ratio(s, model):
    codes = [secrets.ALPHABET.find(c) + 1 for c in s]
    return sum(model[a * (len(secrets.ALPHABET) + 1) + b] for a, b in zip(codes, codes[1:])) / (len(s) - 1)


def ordinary_and_keys():
    """Identifiers of words that the corpus doesn't have, all with digits; and keys."""
    r = random.Random(1)
    words = "get set user cache from async index page file name server client request token list update read write date value error handler service factory config data model column stream thread queue tree node graph route query filter group count summary article backup release branch commit merge".split()
    w = lambda: r.choice(words)
    ordinary, keys = [], []
    for i in range(100):
        y, mo, d = r.randint(1990, 2030), r.randint(1, 12), r.randint(1, 28)
        ordinary += [f"{w()}/{y}/{mo:02}/{w()}-{w()}-{r.randint(1, 99)}", f"{y}-{mo:02}-{d:02}T{r.randint(0, 23):02}-{r.randint(0, 59):02}-00Z-{w()}-{w()}", f"{w()}{w().title()}{r.randint(1, 9)}{w().title()}{w().title()}{r.randint(1, 99)}", f"{w()}_{y}{mo:02}{d:02}_{r.randint(0, 235959):06}_{w()}", f"src/main/{w()}/{w()}/{w()}{r.randint(1, 9)}/{w().title()}Test", f"{w().upper()}_{w().upper()}_{r.randint(1, 999)}_{w().upper()}", f"{w()}-{w()}-v{r.randint(1, 9)}-{r.randint(0, 9)}-{w()}", f"{w()}{r.randint(1, 9)}_{w()}_{w()}_{r.randint(0, 9999)}_{w()}"]
        digest = hashlib.sha256(f"key {i}".encode()).digest()
        keys += [base64.b64encode(digest).decode().rstrip("=")[: r.randint(20, 43)], digest.hex()[: r.randint(20, 31)], base64.urlsafe_b64encode(digest).decode().rstrip("=")]
    ordinary += ["wiki/2019/05/some-article-title-12", "2024-01-05T10-00-00Z-server-log", "utf8_general_ci_utf8mb4_0900", "src/main/java/com/example/app2/Test1", "img_20210304_120000_edited", "getUserById2FromCache3Async"]
    fit = lambda xs: [x for x in xs if len(x) >= secrets.LEAST and re.search("[0-9]", x) and re.search("[A-Za-z]", x)]
    return fit(ordinary), fit(keys)


def candidate(x):
    digit, small, large = (re.search(p, x) for p in ("[0-9]", "[a-z]", "[A-Z]"))
    return (digit and (small or large) and not re.search(secrets.UUID, x)) or (small and large and not digit)


def other_shapes():
    """Constants with digits, names of letters only in both cases, UUIDs; and keys of letters only. Their words are neither the corpus's nor those above."""
    r = random.Random(11)
    words = "kernel vector matrix socket buffer packet driver render shader texture polygon mutex semaphore compiler parser lexer token scanner emitter linker loader debug trace profile sample metric gauge histogram bucket region cluster tenant invoice payment ledger".split()
    w = lambda: r.choice(words)
    chips = ["X86", "AVX512", "SHA256", "ARM64", "UTF8", "MD5", "V2", "I18N", "H264", "CRC32", "P384", "RSA2048"]
    constants = ["_".join(r.sample([w().upper(), r.choice(chips), w().upper(), w().upper(), r.choice(chips)], 5)) for _ in range(400)]
    names = [x for _ in range(150) for x in (w() + "".join(w().title() for _ in range(3)), "/".join([w(), w(), w().title() + w().title()]), "".join(w().title() for _ in range(4)), f"{w()}-{w()}_{w().title()}_{w()}")]
    uuids = ["-".join((h := hashlib.md5(str(i).encode()).hexdigest())[a:b] for a, b in ((0, 8), (8, 12), (12, 16), (16, 20), (20, 32))) for i in range(100)]
    letters = ["".join(r.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", k=r.randint(20, 43))) for _ in range(300)]
    return constants, [x for x in names if len(x) >= secrets.LEAST], uuids, letters


def test_other_shapes(spark, model):
    groups = other_shapes()
    df = spark.createDataFrame([(g, x) for g, xs in enumerate(groups) for x in xs], "doc_id long, text string")
    flagged = {r.doc_id: r.n for r in secrets.scan(df, model).groupBy("doc_id").agg(F.count_if(F.size("spans") > 0).alias("n")).collect()}
    constants, names, uuids, letters = ((flagged[g], len(xs)) for g, xs in enumerate(groups))
    assert constants[0] <= 0.02 * constants[1] and names[0] <= 0.02 * names[1] and uuids[0] == 0
    assert letters[0] >= 0.95 * letters[1]


def test_models_tell_keys_from_identifiers(spark, model):
    ordinary, keys = ordinary_and_keys()
    assert len(ordinary) >= 500 and len(keys) >= 200
    df = spark.createDataFrame(list(enumerate(ordinary + keys)), "doc_id long, text string")
    found = {x.doc_id for x in secrets.scan(df, model).where(F.size("spans") > 0).collect()}
    assert sum(i < len(ordinary) for i in found) <= 0.02 * len(ordinary)
    assert sum(i >= len(ordinary) for i in found) >= 0.95 * len(keys)


def test_markov_spans_equal_a_plain_scorer(spark, model):
    r = random.Random(4)
    ordinary, keys = ordinary_and_keys()
    rows = [(i, "".join(r.choice([*ordinary, *keys, "token=abcdefgh12345", "0123456789abcdef" * 2, "é", "😀 "]) + r.choice([" ", "\n", "(", "."]) for _ in range(r.choice([1, 5, 300])))) for i in range(60)]
    got = {x.doc_id: x.spans for x in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    some = 0
    for i, text in rows:
        known = [(m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
        known += [m.span() for m in re.finditer(r"AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}", text)]
        want = [m.span() for m in re.finditer(secrets.CANDIDATE, text) if candidate(m[0]) and ratio(m[0], model) >= secrets.MARGIN and not any(s < m.end() and m.start() < e for s, e in known)]
        assert [(x["start"], x["end"]) for x in got[i] if x["kind"] == "markov"] == want
        some += len(want)
    assert some > 500


def test_running(spark):
    r = random.Random(2)
    rows = [[], [3], [r.randint(0, 9) for _ in range(64)], [r.randint(0, 9) for _ in range(65)], [r.randint(0, 99) for _ in range(1000)]]
    df = spark.createDataFrame([(x,) for x in rows], "x array<int>").coalesce(1)
    got = df.select(secrets.running(F.col("x"), lambda a, b: a + b).alias("s"), secrets.running(F.col("x"), F.greatest).alias("m")).collect()
    for x, g in zip(rows, got, strict=True):
        assert g.s == [sum(x[:i]) for i in range(len(x))] and g.m == [max([0, *x[:i]]) for i in range(len(x))]


def test_redact_and_empty(spark):
    df = spark.createDataFrame([(1, "x é token=abcdefgh12345 y " + "0123456789abcdef" * 2), (2, "clean")], "doc_id long, text string")
    model = [0.0] * (len(secrets.ALPHABET) + 1) ** 2
    out = {r.doc_id: r.t for r in secrets.scan(df, model).select("doc_id", secrets.redact(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert out == {1: "x é [SECRET] y [SECRET]", 2: "clean"}
    assert secrets.scan(df.where("false"), model).count() == 0
    assert len(secrets.model_of(df.where("false"))) == len(model)


@pytest.mark.parametrize("spans,want", [([(0, 3, "hex"), (2, 5, "assign")], "[SECRET]f"), ([], "abcdef"), ([(5, 6, "hex")], "abcde[SECRET]")])
def test_redact_overlaps(spark, spans, want):
    df = spark.createDataFrame([("abcdef", spans)], "text string, spans array<struct<start:int,end:int,kind:string>>")
    assert df.select(secrets.redact(F.col("text"), F.col("spans"))).first()[0] == want
