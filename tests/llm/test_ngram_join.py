import random
import re

import numpy as np
import pyarrow as pa
import pytest

from commitloom.llm import ngram_join as nj
from commitloom.llm import queries


def brute(rows, width, percent):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    first = {}
    for i, (d, _) in enumerate(rows):
        j = first.setdefault(d, i)
        up[max(find(i), find(j))] = min(find(i), find(j))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                k = len(sets[i] & sets[j])
                if 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                    a, b = find(i), find(j)
                    up[max(a, b)] = min(a, b)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, len(sets[i]), low[find(i)]) for i, (d, _) in enumerate(rows))


def run(spark, rows, width, percent):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, s1 string, n int").repartition(3)
    return sorted(tuple(r) for r in nj.link(df, width, percent).collect())


def corpus(seed, n):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = r.choices(vocabulary, k=30)
    out = []
    while len(out) < n:
        base = r.choices(vocabulary, k=r.choice([3, 6, 12, 40, 90, 200]))
        if r.random() < 0.4:
            base[len(base) // 2 : len(base) // 2] = passage
        for _ in range(r.choice([1, 1, 2, 6])):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 40))):
                k = r.randrange(len(w))
                w[k : k + r.choice([0, 1, 1])] = [r.choice(vocabulary)]
            out.append(r.choice([" ", "\n", "\t "]).join(r.choice([x, x, x.upper()]) if len(out) % 3 else x for x in w))
    return out


@pytest.mark.parametrize("width,percent,block", [(4, 85, 256), (5, 80, 256), (4, 85, 8)])
def test_links_equal_brute_force(spark, monkeypatch, width, percent, block):
    monkeypatch.setattr(nj, "BLOCK", block)
    texts = corpus(width + block, 250) + [None, "", " \n", "one", "One", "a b c", "a b c", "word " * 30000, "é É", "é é", "É É"]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)] + [(4, "repeated id"), (4, texts[9])]
    assert run(spark, rows, width, percent) == brute(rows, width, percent)


def test_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK", 16)
    r = random.Random(9)
    base = [f"v{r.randrange(10_000)}" for _ in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = f"z{r.randrange(10_000)}"
        rows.append((i, " ".join(w)))
    assert run(spark, rows, 4, 85) == brute(rows, 4, 85)


def test_chain_of_small_steps(spark):
    words = [f"q{i}" for i in range(400)]
    rows = [(i, " ".join(words[i * 4 : i * 4 + 103])) for i in range(60)]
    assert run(spark, rows, 4, 85) == brute(rows, 4, 85)


def test_alike_sets_share_a_tile():
    rng = np.random.default_rng(5)
    for percent in (80, 85):
        like = nj.Similar(percent)
        for _ in range(400):
            n = int(rng.integers(1, 300))
            shared = rng.integers(0, 2**63, n).astype(np.uint64)
            extra = rng.integers(0, n // 5 + 2, 2)
            a, b = (np.unique(np.concatenate([shared, rng.integers(0, 2**63, int(e)).astype(np.uint64)])) for e in extra)
            k = len(np.intersect1d(a, b))
            if like.alike(len(a), len(b), k):
                sets = nj.Sets(np.r_[a, b], np.array([0, len(a)]), np.array([len(a), len(b)]))
                # whichever shingles come last
                late = rng.choice(nj.in_bands(sets, like)[2], n // 2)
                last = np.zeros(128, np.uint8)
                for shift in (0, 32):
                    at = (late >> np.uint64(shift)) & np.uint64(1023)
                    np.bitwise_or.at(last, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
                for filled in (None, last):
                    keys, rows = nj.tile_keys(sets, like, filled)
                    assert set(keys[rows == 0].tolist()) & set(keys[rows == 1].tolist())
                bits = min(nj.bits_of(len(a)), nj.bits_of(len(b)))
                x, y = (nj.folded(m, bits // 8) for m in nj.bitmaps(sets, np.array([nj.bits_of(len(a)), nj.bits_of(len(b))])))
                assert like.may(len(a), len(b), int(np.bitwise_count(x ^ y).sum()))


def test_shingles_of_whole_texts():
    texts = ["", None, " \v a\tB  c\x0cD\r\n", "x", "É é É é É", "\x1c\x85 a\xa0b c", "a b a b a b", "k " * 5_000]
    for width in (1, 4, 5):
        sets = nj.shingles(pa.array(texts, pa.string()), width)
        for i, t in enumerate(texts):
            w = (t or "").encode().lower().split()
            assert sets.sizes[i] == len({tuple(w[j : j + width]) for j in range(max(1, len(w) - width + 1))} if w else ())
            assert (np.diff(sets[i].astype(object)) > 0).all()
    a, b = nj.shingles(pa.array(["a b c", "a  B\nC"], pa.string()), 4), nj.shingles(pa.array(["skip", "a b c"]).slice(1), 4)
    assert a[0].tolist() == a[1].tolist() == b[0].tolist()


def test_tiles_are_cut_where_sizes_leave_a_gap(spark):
    like = nj.Similar(80)
    flat = np.arange(5_000, dtype=np.uint64)
    sets = nj.Sets(flat, np.array([0, 10, 110, 230]), np.array([10, 100, 120, 150]))
    names = nj.signed(nj.size_names(sets)).tolist()
    assert names == sorted(names)
    # 150 is alike to 120 at most, 100 to 120; 10 to none
    rows = spark.createDataFrame([(k, n) for k in (1, 2) for n in names], "key long, s1 long").union(spark.createDataFrame([(3, names[0]), (3, names[3])], "key long, s1 long"))
    got = {(r.tile, tuple(r.members)) for r in nj.crowded(rows, 2, None, like).collect()}
    assert {m for _, m in got} == {tuple(names[1:])}
    for percent in (1, 50, 80, 85, 100):
        like = nj.Similar(percent)
        for n in [*range(1, 300), 1_000, 4_097, 99_999]:
            assert int(nj.CLASSES * np.log2(like.largest(n))) - int(nj.CLASSES * np.log2(n)) <= like.classes


def test_crowded_tiles_come_last(spark, monkeypatch):
    """A passage that most documents hold makes crowded tiles, which are made anew without losing a link."""
    monkeypatch.setattr(nj, "CHUNK", 4)
    monkeypatch.setattr(nj, "LAST_COUNT", 10**6)
    r = random.Random(3)
    passage = [f"p{i}" for i in range(12)]
    rows = []
    for i in range(120):
        words = [f"w{r.randrange(3_000)}" for _ in range(40)]
        rows += [(2 * i, " ".join(words[:20] + passage + words[20:])), (2 * i + 1, " ".join(words[:20] + passage + words[20:] + ["end"]))][: 1 + i % 2]
    assert run(spark, rows, 4, 85) == brute(rows, 4, 85)


def test_sets_that_meet_by_chance_get_no_bitmaps(spark, monkeypatch):
    """Each document shares one shingle with each of twelve others, and two have a near copy."""
    asked, real = [], nj.bitmap_stars

    def stars(rows, *args):
        asked.append(rows.count())
        return real(rows, *args)

    monkeypatch.setattr(nj, "bitmap_stars", stars)
    r = random.Random(4)
    rows = []
    for i in range(300):
        pieces = [" ".join(f"s{a}_{b}_{w}" for w in range(4)) for k in range(1, 7) for a, b in ((i, (i + k) % 300), ((i - k) % 300, i))]
        pieces += [f"u{i}_{w}" for w in range(12)]
        r.shuffle(pieces)
        rows.append((i, " ".join(pieces)))
    rows += [(1000 + i, rows[i][1] + " end") for i in (5, 77)]
    assert run(spark, rows, 4, 85) == brute(rows, 4, 85)
    assert asked[0] == 4


@pytest.mark.parametrize("percent", [30, 85])
def test_tiles_of_few_or_many_sets_lose_no_link(spark, monkeypatch, percent):
    """Tiles of more than two sets count as crowded and are made anew, with what they hold last."""
    monkeypatch.setattr(nj, "FEW", 2)
    monkeypatch.setattr(nj, "MET_BY_CHANCE", 0)
    monkeypatch.setattr(nj, "MOST_LAST", 50)
    rows = list(enumerate(corpus(percent, 150)))
    assert run(spark, rows, 4, percent) == brute(rows, 4, percent)


def test_alike_sets_meet_as_often_as_is_counted():
    rng = np.random.default_rng(6)
    for percent in (10, 50, 80, 85, 100):
        like = nj.Similar(percent)
        for _ in range(300):
            n = int(2 ** rng.uniform(0, 9))
            shared = rng.integers(0, 2**63, n).astype(np.uint64)
            a, b = (np.unique(np.r_[shared, rng.integers(0, 2**63, int(rng.integers(0, 100 * n // percent - n + 2))).astype(np.uint64)]) for _ in "ab")
            if like.alike(len(a), len(b), n):
                sets = nj.Sets(np.r_[a, b], np.array([0, len(a)]), np.array([len(a), len(b)]))
                keys, rows = nj.tile_keys(sets, like, None)
                band = nj.band_of(min(len(a), len(b)))
                both = [k for k in set(keys[rows == 0].tolist()) & set(keys[rows == 1].tolist()) if k >> 58 == band]
                assert len(both) >= like.meetings(band)


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert nj.link(df).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, ""), (None, "a b c d e")], "doc_id long, text string")
    assert sorted(map(tuple, nj.link(nothing).collect()), key=str) == [(1, 0, 1), (2, 0, 2), (None, 1, None)]


def test_query(spark):
    rows = queries.op1_ngram_join(spark, "/root/testdata/sf0.01").collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in rows) == brute(docs, 4, 85)
