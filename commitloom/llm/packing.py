"""Best-fit packing of tokenized documents into sequences of a fixed length.

Each task packs what it reads: at most ``open_bins`` bins are open at a time, kept in lists by free
space, with a bitset of the free spaces that occur. The lowest set bit at or above a piece's length is
the best fit; when too many bins are open, the fullest closes. Nothing is shuffled, and a lost task
packs its own split again.
"""

from __future__ import annotations

import functools
import json
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from commitloom.llm import common

SCHEMA = [("doc_id", pa.int64()), ("piece", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
SCHEMA[1] = ("piece", pa.int32())


class SpaceCutEncoder:
    """Ids of a byte-level BPE tokenizer, as little-endian 32-bit integers, by a cache of words.

    A single space between other characters always begins a token, so texts are cut there and each
    different word is encoded once. Texts in which a space stands between white space, or ends the
    text after white space, are encoded whole, and those with a special token by the tokenizer itself.
    Words are encoded by ranks, many in one call, if the vocabulary's ids are in order of its merges.
    """

    #: A space whose neighbours let the pre-tokenizer's white-space rules look past the cut.
    WHOLE = re.compile(r"\s (?=\s|\Z)")
    #: A word that can be encoded in a row with others.
    JOINS = re.compile(r"\S+")

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        self.special = [t["content"] for t in data["added_tokens"]]
        self.ranked = by_rank(data)
        #: Ids of words after a space.
        self.known: dict[str, bytes] = {}

    @functools.cached_property
    def tokenizer(self):
        """The library's tokenizer, loaded only where a text needs it."""
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(self.path)
        made.no_truncation()
        made.no_padding()
        return made

    def _slow(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _encode(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without special tokens."""
        if self.ranked is None:
            return self._slow(texts)
        return [np.array(self.ranked[0].encode_ordinary(t), "<u4").tobytes() for t in texts]

    def _learn(self, words: list[str]) -> None:
        joined = [w for w in words if self.JOINS.fullmatch(w)] if self.ranked else []
        if joined:
            encoding, lengths = self.ranked
            ids = np.array(encoding.encode_ordinary(" " + " ".join(joined)), "<u4")
            ends = np.cumsum([len(w.encode()) + 1 for w in joined])
            at = np.searchsorted(np.cumsum(lengths[ids]), ends) + 1
            self.known.update(zip(joined, [x.tobytes() for x in np.split(ids, at[:-1])], strict=True))
        rest = [w for w in words if w not in self.known]
        self.known.update(zip(rest, self._encode([" " + w for w in rest]), strict=True))

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > common.CACHE_WORDS:
            self.known.clear()
        out: list[bytes] = [b""] * len(texts)
        cut: list[tuple[int, list[str]]] = []
        for i, text in enumerate(texts):
            if any(s in text for s in self.special):
                out[i] = self._slow([text])[0]
            elif self.WHOLE.search(text):
                out[i] = self._encode([text])[0]
            else:
                cut.append((i, text.split(" ")))
        known = self.known
        self._learn(list({w for _, words in cut for w in words[1:] if w not in known}))
        for (i, words), first in zip(cut, self._encode([words[0] for _, words in cut]), strict=True):
            out[i] = first + b"".join([known[w] for w in words[1:]])
        return out


def by_rank(data: dict):
    """(encoding by ranks, bytes of each id) of a byte-level BPE tokenizer; None if its ids aren't in order of its merges."""
    import tiktoken

    model = data["model"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"][a + b] for a, b in pairs]
    plain = data["normalizer"] is None and data["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    if not plain or made != sorted(made) or len(made) + 256 != len(model["vocab"]) or made[0] != 256:
        return None
    # the byte-level alphabet: printable bytes stand for themselves, the others in order from 256 on
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    alphabet = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    ranks = {bytes([alphabet[c] for c in token]): i for token, i in model["vocab"].items()}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        lengths[i] = len(token)
    return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


@functools.cache
def encoder(path: str) -> SpaceCutEncoder:
    """One encoder, and so one cache, for all tasks of a worker."""
    return SpaceCutEncoder(path)


class Bins:
    """Open bins of one task."""

    def __init__(self, size: int, open_bins: int, first_id: int):
        self.size, self.most, self.next_id = size, open_bins, first_id
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]
        self.free_bits, self.open = 0, 0

    def _take(self, free: int) -> int:
        """A bin with so much free space, no longer listed."""
        name = self.by_free[free].pop()
        if not self.by_free[free]:
            self.free_bits &= ~(1 << free)
        self.open -= 1
        return name

    def place(self, length: int) -> tuple[int, int]:
        """The bin and the place in it of a piece of so many tokens (1 to size)."""
        if fits := self.free_bits >> length:
            free = length + (fits & -fits).bit_length() - 1
            name = self._take(free)
        else:
            if self.open >= self.most:
                self._take((self.free_bits & -self.free_bits).bit_length() - 1)
            free, name, self.next_id = self.size, self.next_id, self.next_id + 1
        if left := free - length:
            self.by_free[left].append(name)
            self.free_bits |= 1 << left
            self.open += 1
        return name, self.size - free


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; the first may be shorter."""
    first = n % size or size
    return [(0, first), *((at, size) for at in range(first, n, size))]


def pack(docs: DataFrame, tokenizer_path: str | None = None, size: int = 1024, end_id: int = 2, open_bins: int = 4096) -> DataFrame:
    """A row for each piece of each document: where its tokens stand in which sequence.

    ``docs`` needs doc_id and text; other columns are ignored. A document is its ids and then ``end_id``,
    so null and empty texts are one token. Documents of more than ``size`` tokens are cut; others stay
    whole. Rows of equal doc_id are documents of their own; an empty table gives no rows. Of each block
    of rows the longest pieces are placed first. ``sequence_id`` is the task's number and a count.
    """
    path = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encode = encoder(path)
        bins = Bins(size, open_bins, TaskContext.get().partitionId() << 36)
        for batch in batches:
            pieces = []
            for block in common.blocks(batch):
                for doc_id, ids in zip(block.column("doc_id").to_pylist(), encode(common.texts(block)), strict=True):
                    ids += end
                    for k, (start, length) in enumerate(cut(len(ids) // 4, size)):
                        pieces.append((doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
            pieces.sort(key=lambda p: -p[3])
            rows = [(*p, *bins.place(p[3])) for p in pieces]
            yield common.record(SCHEMA, *(zip(*rows, strict=True) if rows else [[]] * 7))

    return docs.select("doc_id", "text").mapInArrow(run, DDL)
