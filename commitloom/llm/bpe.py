"""BPE encoding and decoding with the merges done for many words at once.

The symbols of all words not seen before lie in one flat array. In each round every word's
lowest-ranked pair is found by binary search over sorted pair keys, and all its places are merged;
words without a pair left drop out. Encoded words, and pieces of text between white space made of them, are
kept by bounded caches: ids lie in flat arrays, from which those of whole texts are gathered at once.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from commitloom.llm import common

#: White space as the tokenizer's normalizer knows it; texts are cut there, as no token crosses it.
SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Pieces that the normalizer only puts into lower case, letter by letter; and its words in many of them, one piece a line.
PLAIN = re.compile("[!-~\xa1-\u012f\u0131-\u017f]+")
PLAIN_WORD = regex.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Names of special tokens among those of words, which hold no space.
SPECIAL = " "
NONE = np.int64(2**62)


class Merges:
    """A word-end BPE vocabulary: symbols of words to ids, and back."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.names = {i: s for s, i in (*self.vocab.items(), *self.special.items())}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.width = max(self.names) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([self.vocab[a] * self.width + self.vocab[b] for a, b in pairs], np.int64)
        made = np.array([self.vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        # the byte-level alphabet: printable bytes stand for themselves, the others in order from 256 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        self.alphabet = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
        parts = Tokenizer.from_file(path)
        self.normalize, self.pre_tokenize = parts.normalizer.normalize_str, parts.pre_tokenizer.pre_tokenize_str

    def byte_level(self, word: str) -> str:
        return word if word.isascii() else word.encode().decode("latin-1").translate(self.alphabet)

    def words_of(self, piece: str) -> list[str]:
        """Byte-level words, and names of special tokens, of any piece."""
        out = []
        for k, part in enumerate(self.split_special.split(piece) if self.split_special else [piece]):
            if k % 2:
                out.append(SPECIAL + part)
            else:
                out += [w for x in SPACE.split(part) for w, _ in self.pre_tokenize(self.normalize(x))]
        return out

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def ranks_of(self, symbols: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The rank of the pair that begins at each place ``at``; NONE at a word's end."""
        out = np.full(len(at), NONE)
        inside = at < len(symbols) - 1
        inside[inside] = word[at[inside] + 1] == word[at[inside]]
        out[inside] = self.rank(symbols[at[inside]], symbols[at[inside] + 1])
        return out

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words (none is empty), one after the other, and how many each has."""
        vocab, suffix = self.vocab, self.suffix
        symbols = np.array([vocab[c] for w in words for c in (*w[:-1], w[-1] + suffix)], np.int64)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        rank = self.ranks_of(symbols, word, np.arange(len(symbols)))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[starts, len(symbols)])
            lowest = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            live = lowest < NONE
            done.append((word[~live], symbols[~live]))
            symbols, word, rank, lowest = symbols[live], word[live], rank[live], lowest[live]
            at = np.flatnonzero(rank == lowest)
            if not len(at):
                break
            # of overlapping places, as in a run of one symbol, every other one from the left
            run = np.cumsum(np.r_[True, np.diff(at) != 1])
            first = at[np.r_[True, run[1:] != run[:-1]]][run - 1]
            at = at[(at - first) % 2 == 0]
            symbols[at] = self.made[rank[at]]
            stay, fresh = np.ones(len(symbols), bool), np.zeros(len(symbols), bool)
            stay[at + 1] = False
            # only pairs with a merged symbol have another rank now
            fresh[at] = fresh[at[at > 0] - 1] = True
            symbols, word, rank, fresh = symbols[stay], word[stay], rank[stay], fresh[stay]
            fresh = np.flatnonzero(fresh)
            rank[fresh] = self.ranks_of(symbols, word, fresh)
        of, ids = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.empty(0, int),) * 2
        order = np.argsort(of, kind="stable")
        return ids[order], np.bincount(of, minlength=len(words))

    def named(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """What ``encode_words`` gives, also for names of special tokens."""
        special = np.array([self.special[n[1:]] if n[0] == SPECIAL else -1 for n in names], np.int64)
        ids, sizes = self.encode_words([n for n in names if n[0] != SPECIAL])
        every = np.ones(len(names), np.int64)
        every[special < 0] = sizes
        out = np.empty(every.sum(), np.int64)
        plain = np.repeat(special < 0, every)
        out[plain], out[~plain] = ids, special[special >= 0]
        return out, every

    def decode(self, ids: np.ndarray) -> str:
        """Tokens with spaces between, as a tokenizer without a decoder gives them; unknown ids are left out."""
        return " ".join([self.names[i] for i in ids.tolist() if i in self.names])


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` that begin at ``starts`` and have ``sizes`` elements, one after the other."""
    ends = np.cumsum(sizes)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)]


class Cache:
    """Ids by name, in one flat array. When it is full, names that nobody has asked for since it last was go."""

    def __init__(self, most: int):
        self.most = most
        self.at: dict[str, int] = {}
        self.flat, self.starts, self.sizes, self.used = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def rows(self, names: list[str], make) -> np.ndarray:
        """The rows of different names; ``make`` gives the ids of those not known, and how many each has."""
        if len(self.at) > self.most:
            self._age()
        at = self.at
        found = np.fromiter(map(at.get, names, itertools.repeat(-1)), np.int64, len(names))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new = [names[i] for i in missing.tolist()]
            flat, sizes = make(new)
            found[missing] = np.arange(len(at), len(at) + len(new))
            at.update(zip(new, found[missing].tolist(), strict=True))
            self.starts = np.r_[self.starts, len(self.flat) + np.cumsum(sizes) - sizes]
            self.flat, self.sizes = np.r_[self.flat, flat.astype(np.int32)], np.r_[self.sizes, sizes]
            self.used = np.r_[self.used, np.ones(len(new), bool)]
        self.used[found] = True
        return found

    def _age(self) -> None:
        keep = np.flatnonzero(self.used)[-(self.most // 2) :]
        names = list(self.at)
        self.at = {names[i]: k for k, i in enumerate(keep.tolist())}
        self.flat = gathered(self.flat, self.starts[keep], self.sizes[keep])
        self.sizes = self.sizes[keep]
        self.starts, self.used = np.cumsum(self.sizes) - self.sizes, np.zeros(len(keep), bool)

    def ids(self, rows: np.ndarray) -> np.ndarray:
        return gathered(self.flat, self.starts[rows], self.sizes[rows])


class CachedBpe:
    """Encoded and decoded texts, by caches of words and of pieces between white space."""

    def __init__(self, path: str, most: int = common.CACHE_WORDS):
        self.merges = Merges(path)
        self.words, self.pieces = Cache(most), Cache(most)
        tokens = [(self.merges.names.get(i, "") + " ").encode() for i in range(self.merges.width)]
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_sizes = np.array([len(t) for t in tokens], np.int64)
        self.token_starts = np.cumsum(self.token_sizes) - self.token_sizes

    def _made(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, and how many each has."""
        merges = self.merges
        special = merges.split_special
        plain = np.array([bool(PLAIN.fullmatch(p)) and not (special and special.search(p)) for p in pieces], bool)
        # numbers of byte-level words, one after the other, and the piece of each
        number: dict[str, int] = {}
        found = PLAIN_WORD.findall("\n".join([p for p, ok in zip(pieces, plain.tolist(), strict=True) if ok]).lower())
        kinds = {w: number.setdefault(merges.byte_level(w), len(number)) if w != "\n" else -1 for w in dict.fromkeys(found)}
        of = np.fromiter(map(kinds.__getitem__, found), np.int64, len(found))
        piece = np.flatnonzero(plain)[np.cumsum(of < 0)[of >= 0]] if len(of) else np.empty(0, np.int64)
        words, pieces_of = [of[of >= 0]], [piece]
        for i in np.flatnonzero(~plain).tolist():
            own = [number.setdefault(w, len(number)) for w in merges.words_of(pieces[i])]
            words.append(np.array(own, np.int64))
            pieces_of.append(np.full(len(own), i))
        word, piece = np.concatenate(words), np.concatenate(pieces_of)
        order = np.argsort(piece, kind="stable")
        rows = self.words.rows(list(number), merges.named)[word[order]]
        return self.words.ids(rows), np.bincount(piece[order], self.words.sizes[rows], len(pieces)).astype(np.int64)

    def __call__(self, texts: pa.Array | list[str]) -> list[tuple[bytes, bytes]]:
        """(ids as little-endian 32-bit integers, decoded text in UTF-8) of each text, null as empty."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        # a copy, as ascii_lower misreads slices
        whole = texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string()).fill_null("")
        # ASCII letters in lower case here make fewer pieces; not where that could make a special token
        lower = pc.ascii_lower(whole)
        for name in self.merges.special:
            lower = pc.if_else(pc.match_substring(lower, name.lower()), whole, lower)
        # pieces between ASCII white space; any other is cut where a piece is made
        cut = pc.ascii_split_whitespace(lower)
        kinds = cut.flatten().dictionary_encode()
        row = self.pieces.rows(kinds.dictionary.to_pylist(), self._made)[kinds.indices.to_numpy()]
        ids = self.pieces.ids(row)
        ends = np.cumsum(np.r_[0, self.pieces.sizes[row]])[np.cumsum(cut.value_lengths().to_numpy(zero_copy_only=False))]
        decoded = gathered(self.token_bytes, self.token_starts[ids], self.token_sizes[ids]).tobytes()
        places = np.cumsum(np.r_[0, self.token_sizes[ids]])[ends].tolist()
        raw, ends = ids.astype("<u4").tobytes(), (4 * ends).tolist()
        # without the last token's space
        return [(raw[a:b], decoded[c : max(c, d - 1)]) for a, b, c, d in zip([0, *ends], ends, [0, *places], places, strict=False)]


@functools.cache
def cached(path: str) -> CachedBpe:
    """One cache for all tasks of a worker."""
    return CachedBpe(path)


SCHEMA = [("doc_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("decoded", pa.string())]
DIGESTS = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]


def encode(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """doc_id, ids, decoded (the ids decoded again) of every document.

    ``docs`` needs doc_id and text; other columns are ignored. Null texts count as empty, which have no
    ids and decode to the empty text. Repeated rows give repeated results; an empty table gives none.
    """
    path = tokenizer_path or public_tokenizers.path("word_bpe_49k.json")

    def make():
        bpe = cached(path)

        def work(block):
            found = bpe(block.column("text"))
            return common.record(SCHEMA, block.column("doc_id"), [np.frombuffer(x[0], "<u4").astype(np.int64) for x in found], [x[1].decode() for x in found])

        return work

    return docs.select("doc_id", "text").mapInArrow(common.by_block(make), "doc_id long, ids array<long>, decoded string")


def digests(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document: what ``encode`` gives, as digests made where it is made."""
    path = tokenizer_path or public_tokenizers.path("word_bpe_49k.json")

    def make():
        bpe = cached(path)

        def work(block):
            found = bpe(block.column("text"))
            sha = lambda k: [hashlib.sha256(x[k]).hexdigest() for x in found]
            return common.record(DIGESTS, block.column("doc_id"), [len(x[0]) // 4 for x in found], sha(0), sha(1))

        return work

    return docs.select("doc_id", "text").mapInArrow(common.by_block(make), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode(encoded: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """doc_id, text of rows with doc_id and ids; null ids give the empty text, unknown ids and null elements are left out."""
    path = tokenizer_path or public_tokenizers.path("word_bpe_49k.json")

    def run(batches):
        merges = Merges(path)
        for batch in batches:
            ids = [np.array([i for i in x or [] if i is not None], np.int64) for x in batch.column("ids").to_pylist()]
            yield common.record([("doc_id", pa.int64()), ("text", pa.string())], batch.column("doc_id"), [merges.decode(x) for x in ids])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
