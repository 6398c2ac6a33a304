"""Word shingle sets as sorted 64-bit values, for whole batches of texts at a time."""

from __future__ import annotations

import numpy as np

from .common import byte_table, mix64

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_VALUE = byte_table(17)
_VALUE[65:91] = _VALUE[97:123]  # A-Z are lowered
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEPS = [np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0x589965CC75374CC3)]


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _BASE)
    out[0] = 1
    return np.cumprod(out)


def word_hashes(bytes_: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A value for every word and the number of words of each text."""
    inside = ~_SPACE[bytes_]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = offsets[:-1][np.diff(offsets) > 0]
    first[begins] = inside[begins]  # a text begins a word though the one before ends in one
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    word = np.cumsum(first)[at] - 1
    starts = np.flatnonzero(first)
    lengths = np.bincount(word)
    value = _VALUE[bytes_[at]] * powers(int(lengths.max()))[at - starts[word]]
    heads = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    words = mix64(np.add.reduceat(value, heads) + lengths.astype(np.uint64) * _STEPS[4])
    return words, np.diff(np.searchsorted(starts, offsets))


def shingle_sets(bytes_: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingles of every text. A text with fewer words has its whole sequence as one shingle."""
    words, counts = word_hashes(bytes_, offsets)
    ends = np.cumsum(counts)
    out = []
    if len(words) >= size:
        value = np.zeros(len(words) - size + 1, np.uint64)
        for k in range(size):
            value = mix64(value + words[k : len(words) - size + 1 + k] * _STEPS[k % 5])
    for n, end in zip(counts.tolist(), ends.tolist(), strict=True):
        if n >= size:
            own = np.sort(value[end - n : end - size + 1])
            keep = np.ones(len(own), dtype=bool)
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            out.append(own[keep])
        elif n:
            short = np.full(1, n, np.uint64)
            for k in range(n):
                short = mix64(short * _STEPS[4] + words[end - n + k : end - n + k + 1])
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
