import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from commitloom.llm import langid, toxicity
from commitloom.llm.common import table
from tests.llm.test_ngram_join import brute

DATA = "/root/testdata/sf0.001"


def test_stages_equal_plain_versions(spark, tmp_path):
    docs = table(spark, DATA, "documents")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append({r["doc_id"]: r for r in docs.collect()} if name != "packing" else docs.collect())
        if name != "packing":
            assert docs.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "language_id":
            rows = before.collect()
            langs, scores = langid.Predictor(langid.fit(before))([r.text or "" for r in rows])
            assert set(kept[-1]) == {r.doc_id for r, y, s in zip(rows, langs, scores) if y != "und" and s >= langid.LEAST_SCORE}
        if name == "toxicity":
            rows = before.collect()
            scores = toxicity.Scorer(toxicity.fit(before, table(spark, DATA, "labels")))([r.text or "" for r in rows])
            assert set(kept[-1]) == {r.doc_id for r, s in zip(rows, scores) if s < 0.5}
        if name == "near_duplicates":
            want = {c for _, _, c in brute([(r.doc_id, r.text) for r in before.collect()], 5, 80)}
            assert set(kept[-1]) == want
        if name == "secrets":
            assert set(kept[-1]) == set(kept[-2])
            assert all(r.n_chars == len(r.text) and "AKIA" not in r.text for r in kept[-1].values())
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array(t.encode(r.text, add_special_tokens=False).ids + [2], "<u4") for i, r in kept[-2].items()}
    assert {r.doc_id for r in kept[-1]} == set(ids)
    assert all(zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in kept[-1])
    assert sum(r.length for r in kept[-1]) == sum(map(len, ids.values()))


def test_cases(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "!!! 123", "en", "s", 7), (4, "the and of in to " * 30, "en", "s", 9), (4, "the and of in to " * 30, "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {"language_id": [4, 4], "near_duplicates": [1, 2, 3, 4, 4], "secrets": [1, 2, 3, 4, 4]}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), DATA).collect() == []
        got = stage(spark, docs, DATA).collect()
        if name == "toxicity":
            scorer = toxicity.Scorer(toxicity.fit(docs, table(spark, DATA, "labels")))
            assert sorted(r.doc_id for r in got) == [r[0] for r in rows if scorer([r[1] or ""])[0] < corpus_pipeline.TOXIC]
        elif name == "packing":
            # null and empty texts are the end token alone
            assert sorted((r.doc_id, r.piece) for r in got) == [(1, 0), (2, 0), (3, 0), (4, 0), (4, 0)]
            assert [r.length for r in sorted(got, key=lambda r: r.doc_id)][:2] == [1, 1] and len({r.sequence_id for r in got}) >= 1
        else:
            assert sorted(r.doc_id for r in got) == kept[name]
        if name == "secrets":
            assert sorted((r.doc_id, r.text, r.n_chars) for r in got)[0] == (1, "", 0)


def test_clean_text_of_several_languages_stays(spark):
    rng = random.Random(4)
    make = {"aa": "bcdfa", "bb": "lmnoe", "cc": "ghjki", "dd": "rstvu", "ee": "pqwxy"}
    word = lambda y: "".join(rng.choices(make[y], k=5))
    plain = [(i, " ".join(word(y) for _ in range(80)), y) for i, y in enumerate([*make] * 40)]
    mixed = [(1000 + n, " ".join(word(y) for y in [*make][:n] for _ in range(30)), "aa") for n in (3, 4, 5)]
    known = set("".join(make.values()))
    strange = [(2000, " ".join("".join(rng.choices([c for c in map(chr, range(0x430, 0x450)) if c not in known], k=5)) for _ in range(120)), None)]
    docs = spark.createDataFrame([(i, x, y, "s", len(x)) for i, x, y in plain + mixed + strange], "doc_id long, text string, lang string, source string, n_chars long")
    ids = {r.doc_id for r in corpus_pipeline.language_stage(spark, docs, DATA).collect()}
    assert ids == {i for i, _, _ in plain + mixed}
