import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from commitloom.llm import bpe, packing

PIECES = ["the", "Hello", "wörld", "Straße", "ÉÈ", "İx", "é", "it's", "'tis", "12", "3.5", "<|endoftext|>", "<|startoftext|>x", "<|EndOfText|>", "日本語", "☃☃", "aaaaaaa", "\x1c", "a b", "!!!???", "don't'll", "ΑΣ", "zzzzzzzz", "́"]
SPACES = [" ", "  ", "\n", "\n\n ", " \n ", "\t", "\xa0", "   ", "\r\n", "\x85", "\u2003", "\u3000"]


def samples(n=400):
    r = random.Random(5)
    out = ["", " ", "   ", "\n \n", " a", "a ", "a \n ", "<|endoftext|>", "foo \n <|endoftext|>"]
    for _ in range(n):
        out.append("".join(r.choice(PIECES + ["".join(r.choices("abcdeÀß̈ ", k=5))]) + r.choice(SPACES + [""]) for _ in range(r.randint(1, 30))))
    return out


def test_word_bpe_equals_the_library():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = samples()
    for text, (ids, decoded) in zip(texts, bpe.CachedBpe(public_tokenizers.path("word_bpe_49k.json"))(texts)):
        want = t.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert decoded.decode() == t.decode(want, skip_special_tokens=False), text


def test_space_cut_equals_the_library():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = samples()
    for text, ids in zip(texts, packing.SpaceCutEncoder(public_tokenizers.path("byte_bpe_50k.json"))(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, piece string, n_tokens string")


def test_encode_decode_and_digests(spark):
    texts = [None, "", *samples(30), "word " * 30000]
    docs = frame(spark, [(i, x, "x", "y", "z") for i, x in enumerate(texts)] + [(1, "", None, None, None), (None, "a", None, None, None)])
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: r for r in bpe.digests(docs).collect()}
    full = bpe.encode(docs)
    back = {r.doc_id: r.text for r in bpe.decode(full).collect()}
    assert bpe.digests(docs).count() == len(texts) + 2
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids
        decoded = t.decode(ids, skip_special_tokens=False)
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest() and back[i] == decoded
    assert bpe.digests(frame(spark, [])).count() == 0


@pytest.mark.parametrize("open_bins", [1, 3, 4096])
def test_packing_round_trip(spark, open_bins):
    texts = [None, "", *samples(60), "word " * 5000, "x"]
    docs = frame(spark, [(i, x, "x", "y", "z") for i, x in enumerate(texts)] + [(2, "again", None, None, None)]).coalesce(1)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack(docs, size=64, open_bins=open_bins).collect()
    pieces: dict = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    for i, text in enumerate(texts):
        if i == 2:
            continue
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        mine = sorted(pieces[i], key=lambda r: r.piece)
        assert [r.start for r in mine] == [sum(x.length for x in mine[:k]) for k in range(len(mine))] and sum(r.length for r in mine) == len(ids)
        assert len(mine) == -(-len(ids) // 64) and all(r.length == 64 for r in mine[1:])
        for r in mine:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    bins: dict = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 64
    if open_bins == 4096:
        assert len(bins) <= 1.03 * sum(r.length for r in rows) / 64 + 2
    assert packing.pack(frame(spark, [])).count() == 0


def test_bins_close_the_fullest():
    b = packing.Bins(10, 2, 0)
    assert [b.place(n) for n in (6, 5, 9, 5, 1, 4)] == [(0, 0), (1, 0), (2, 0), (1, 5), (2, 9), (3, 0)]
