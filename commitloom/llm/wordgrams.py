"""Hashed character n-grams of words, for many words at once."""

from __future__ import annotations

import re

import numpy as np

from commitloom.llm.common import mix64

#: Words are runs of letters, and of other word characters that are no digits.
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def hashed(words: list[str], sizes: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature): the n-grams of each word between marks of its beginning and end, and the word as a whole.

    N-grams that touch a mark are affixes. Equal words have equal features; features are below 2 ** bits.
    """
    flat = np.frombuffer("".join([f"\x02{w}\x03" for w in words]).encode("utf-32-le"), "<u4").astype(np.uint64)
    length = np.array([len(w) + 2 for w in words], np.int64)
    word = np.repeat(np.arange(len(words)), length)
    shift = np.uint64(64 - bits)
    out_word, out = [], []
    h = np.zeros(len(flat), np.uint64)
    for n in range(1, max(sizes) + 1):
        h = h[: len(flat) - n + 1] * np.uint64(0x100000001B3) + flat[n - 1 :] + np.uint64(1)
        if n in sizes:
            inside = word[: len(h)] == word[n - 1 :]
            out_word.append(word[: len(h)][inside])
            out.append(mix64(h[inside], n) >> shift)
    # the whole word: a sum of its characters' hashes with their places
    place = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
    parts = mix64(flat + (place.astype(np.uint64) << np.uint64(32)), 99)
    if len(words):
        out_word.append(np.arange(len(words)))
        out.append(mix64(np.add.reduceat(parts, np.cumsum(length) - length), 98) >> shift)
    return np.concatenate(out_word), np.concatenate(out).astype(np.int64)


def sums(words: list[str], weights: np.ndarray, sizes: tuple[int, ...]) -> np.ndarray:
    """For each word the sum of its features' rows of ``weights`` (2 ** bits rows)."""
    if not words:
        return np.zeros((0, weights.shape[1]))
    word, feature = hashed(words, sizes, (len(weights) - 1).bit_length())
    return np.stack([np.bincount(word, weights[feature, k], len(words)) for k in range(weights.shape[1])], axis=1)
