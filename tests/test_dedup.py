import random

import pytest
from pyspark.sql import functions as F

from commitloom.operators import dedup, quotas


def greedy(sigs, threshold, bands=4):
    """What a walk in order drops: rows near a kept earlier one that shares a band."""
    width, kept, gone = 64 // bands, [], []
    parts = lambda s: [(s >> (b * width)) & ((1 << width) - 1) for b in range(bands)]
    for seq, s in sigs:
        s %= 2**64
        near = any(bin(s ^ k).count("1") <= threshold and any(x == y for x, y in zip(parts(s), parts(k))) for k in kept)
        gone.append(seq) if near else kept.append(s)
    return gone


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def test_chain_keeps_both_ends(spark):
    sigs = [(1, 0), (2, 0b111), (3, 0b111111), (4, 0b111111)]
    df = spark.createDataFrame(sigs, "seq long, sig long")
    assert sorted(r.seq for r in dedup.near_duplicates(df).collect()) == [2, 4] == greedy(sigs, 3)


@pytest.mark.parametrize("most", [1_000_000, 5])
def test_near_duplicates_equal_the_walk(spark, monkeypatch, most):
    monkeypatch.setattr(dedup, "GROUP_EDGES", most)
    r = random.Random(4)
    for threshold in (3, 6):
        base = [r.getrandbits(64) for _ in range(12)]
        sigs = []
        for i in range(150):
            s = r.choice(base)
            for _ in range(r.randint(0, 5)):
                s ^= 1 << r.randrange(64)
            sigs.append((i, signed(s)))
        df = spark.createDataFrame(sigs, "seq long, sig long").repartition(3)
        assert sorted(x.seq for x in dedup.near_duplicates(df, threshold).collect()) == greedy(sigs, threshold)


def test_simhash_edges(spark):
    assert dedup.simhash("!!!") == dedup.simhash("!!!") != dedup.simhash("???")
    assert dedup.simhash("a b c d e f") != dedup.simhash("a b c d e g")
    df = dedup.with_simhash(spark.createDataFrame([(1, None), (2, "")], "seq long, t string"), "t").collect()
    assert df[0].sig == df[1].sig


def test_drop_reasons(spark):
    rows = [(1, "r", "S", ""), (2, "r", "S", "+real"), (3, "r", "", "+a"), (4, "r", "", "+b"), (5, "r", "T", "+a \n\n"), (6, "q", " S ", "+c"), (7, "q", "S", "+d"), (8, None, None, None)]
    df = dedup.with_drop_reason(spark.createDataFrame(rows, "seq long, repo string, sha string, diff_text string"))
    got = {r.seq: r.drop_reason for r in df.collect()}
    assert got == {1: "diff", 2: "sha", 3: None, 4: None, 5: "diff", 6: None, 7: "sha", 8: "diff"}
    kept, counts = dedup.deduplicate(spark.createDataFrame(rows, "seq long, repo string, sha string, diff_text string"), near=True)
    assert kept.columns == ["seq", "repo", "sha", "diff_text"]
    assert counts.first().asDict() == {"total": 8, "dropped_sha": 2, "dropped_diff": 3, "dropped_near": 0, "kept": 3}


def test_duplicate_report(spark):
    rows = [(1, "u", "a"), (2, "u", None), (10, "u", "a"), (3, "v", "b"), (4, "v", "b")]
    report = dedup.duplicate_report(spark.createDataFrame(rows, "line long, url string, sha string"), ["url", "sha"])
    got = [tuple(r) for r in report.orderBy("key_ord", F.desc("count"), "value").collect()]
    assert got == [(0, "url", "u", 3, "1;2;10"), (0, "url", "v", 2, "3;4"), (1, "sha", "a", 2, "1;10"), (1, "sha", "b", 2, "3;4")]
    top = dedup.duplicate_preview(report, 1).orderBy("key_ord").collect()
    assert [(r.value, r["more"]) for r in top] == [("u", 1), ("a", 1)]


@pytest.mark.parametrize("most", [7, 100_000])
def test_report_in_pieces(spark, tmp_path, most):
    from commitloom.sources import records

    r = random.Random(5)
    rows = [(i, "hot", r.choice(["a", "b", None, f"only {i}"])) for i in r.sample(range(1, 900), 200)] + [(None, "hot", "none"), (None, "hot", "none")]
    df = spark.createDataFrame(rows, "line long, url string, sha string").repartition(4)
    pieces = dedup.duplicate_pieces(df, ["url", "sha"], most=most)
    got = {}
    for x in pieces.orderBy("key_ord", "value", "piece").collect():
        count, numbers = got.setdefault((x.key, x.value), (x["count"], []))
        assert count == x["count"]
        some = [int(n) for n in x.line_numbers.split(";") if n]
        assert len(some) <= 2 * most
        numbers += some
    want = {(x.key, x.value): (x["count"], [int(n) for n in x.line_numbers.split(";") if n]) for x in dedup.duplicate_report(df, ["url", "sha"]).collect()}
    assert got == want and got["url", "hot"][0] == 202
    assert {(x.key, x.value): x["count"] for x in dedup.duplicate_counts(df, ["url", "sha"]).collect()} == {k: n for k, (n, _) in want.items()}
    records.write_duplicates(pieces, f"{tmp_path}/out")
    lines = [line for p in sorted((tmp_path / "out").glob("part-*")) for line in p.read_text().splitlines() if line.startswith("url,hot,202,")]
    assert [int(n) for line in lines for n in line.removeprefix("url,hot,202,").strip('"').split(";") if n] == want["url", "hot"][1]
    assert dedup.duplicate_pieces(df.where("false"), ["url"]).count() == 0


def test_quota_in_order(spark):
    df = spark.createDataFrame([(1, "f"), (2, "f"), (3, "f"), (4, "d"), (5, "d")], "seq long, label string")
    assert [r.seq for r in quotas.apply_quota(df, 2, 3).orderBy("seq").collect()] == [1, 2, 4]
    assert quotas.apply_quota(df).count() == 5
    assert quotas.quota_counts(df, 2, 3).first() == (3, 1)


def test_equal_seqs_of_blank_rows_and_reasons_of_all_columns(spark):
    rows = [(1, None, None, None, "x"), (2, "r", "S", "+a", "y")]
    df = dedup.with_drop_reason(spark.createDataFrame(rows, "seq long, repo string, sha string, diff_text string, more string"))
    assert df.columns == ["seq", "repo", "sha", "diff_text", "more", "norm_md5", "drop_reason"]
    assert sorted((r.seq, r.drop_reason) for r in df.collect()) == [(1, "diff"), (2, None)]
    assert dedup.with_drop_reason(df.drop("norm_md5", "drop_reason").where("false")).count() == 0


def test_crowded_buckets_are_dealt_into_tiles(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BUCKET", 8)
    # all in one band and one piece of the other bits; and a few elsewhere
    sigs = [(i, i << 40) for i in range(120)] + [(500 + i, (i << 8) | (1 << 62)) for i in range(5)]
    got = sorted(map(tuple, dedup.near_pairs(spark.createDataFrame(sigs, "seq long, sig long")).collect()))
    shared = lambda x: any((x >> 16 * b) & 0xFFFF == 0 for b in range(4))
    want = [(a, b, (x ^ y).bit_count()) for a, x in sigs for b, y in sigs if a < b and (x ^ y).bit_count() <= 3 and shared(x ^ y)]
    assert got == sorted(want) and len(got) > 1_000
