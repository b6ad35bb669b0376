"""Hashes of words and shingles that hold no algebra to build equal ones from."""

from __future__ import annotations

import numpy as np

from . import common

_LENGTH, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits for each span of bytes: eight bytes at a time, mixed before the next eight."""
    size = end - start
    out = common.mix(size.astype(np.uint64) * _LENGTH + _STEP)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))
    live, at = np.arange(len(size)), 0
    while len(live := live[size[live] > at]):
        rest = np.minimum(size[live] - at, 8).astype(np.uint64)
        part = eights[start[live] + at]
        part &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - rest * np.uint64(8))
        out[live] = common.mix(out[live] * _STEP ^ part)
        at += 8
    return out


def chained(words: np.ndarray, k: int) -> np.ndarray:
    """64 bits for each ``k`` consecutive words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, k, np.uint64) * _LENGTH
    for i in range(k):
        out = common.mix(out * _STEP ^ words[i : i + n])
    return out


def shingle_sets(raw: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles of ``k`` words in ascending order of their hashes, and the texts' offsets.

    A-Z count as a-z. Fewer words make one shingle of them all, no word none.
    """
    raw = common.LOWER[raw]
    start, end, words = common.word_spans(raw, off)
    units = word_hashes(raw, start, end)
    count = np.diff(words)
    row = np.repeat(np.arange(len(count)), count)
    grams = chained(units, k)
    inside = np.arange(len(grams)) + k <= words[1:][row[: len(grams)]] if len(grams) else np.zeros(0, bool)
    found, owner = [grams[inside]], [row[: len(grams)][inside]]
    for few in range(1, k):
        rows = np.flatnonzero(count == few)
        if len(rows):
            found.append(chained(units, few)[words[rows]])
            owner.append(rows)
    values, owners = np.concatenate(found), np.concatenate(owner)
    order = np.lexsort((values, owners))
    values, owners = values[order], owners[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owners[1:] != owners[:-1])
    values, owners = values[new], owners[new]
    return values, np.searchsorted(owners, np.arange(len(count) + 1))
