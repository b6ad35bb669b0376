"""Winnowed anchors and the blocks of windows they own.

A window is ``length`` consecutive units (words or bytes) of one text. It is
owned by the seed, ``seed`` consecutive units inside it, of the smallest hash,
the leftmost of equal ones. That choice depends on the window's units alone, so
equal windows anywhere have equal anchors at the same place, and whatever
repeats is found by joining on anchors. Neighbouring windows with the same
anchor form a block: its units from the first window's start to the last one's
end. Blocks of equal anchor and units hold equal windows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from . import common


@dataclass
class Blocks:
    """Blocks of some texts, in order; ``first`` and ``last`` are window starts, ``at`` the anchor's."""

    first: np.ndarray
    last: np.ndarray
    at: np.ndarray
    anchor: np.ndarray
    block: np.ndarray
    row: np.ndarray

    def windows(self, chosen: np.ndarray) -> np.ndarray:
        """The starts of the chosen blocks' windows, in order."""
        return spread(self.first[chosen], self.last[chosen] + 1)


def spread(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All integers of the ranges, one after the other."""
    size = end - start
    ends = np.cumsum(size)
    return np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of ``width`` consecutive values, from each place on."""
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def blocks(units: np.ndarray, off: np.ndarray, length: int, seed: int) -> Blocks:
    """The blocks of texts given as 64-bit units; ``off`` are the texts' offsets, from 0."""
    none = np.zeros(0, np.int64)
    if len(units) < length:
        return Blocks(none, none, none, none.view(np.uint64), none.view(np.uint64), none)
    prefix = common.Prefix(units)
    grams = prefix.grams(seed)
    order = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    anchor_at = (_sliding_min(order, length - seed + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))[: len(anchor_at)]
    starts = np.flatnonzero(np.arange(len(anchor_at)) + length <= off[1:][row])
    if not len(starts):
        return Blocks(none, none, none, none.view(np.uint64), none.view(np.uint64), none)
    at = anchor_at[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (row[starts][1:] != row[starts][:-1])
    head = np.flatnonzero(new)
    first, last, at = starts[head], starts[np.append(head[1:], len(starts)) - 1], at[head]
    # the block's units, and where in them the anchor stands
    whole = common.Prefix(units, common.SECOND).spans(first, last + length)
    return Blocks(first, last, at, grams[at], common.mix(whole + (at - first).astype(np.uint64)), row[first])


def window_hashes(units: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each window, as two columns."""
    return common.Prefix(units).spans(starts, starts + length), common.Prefix(units, common.SECOND).spans(starts, starts + length)


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of ``n`` units lie in a window that begins at one of ``starts``."""
    edge = np.bincount(starts, minlength=n + 1) - np.bincount(starts + length, minlength=n + 1)
    return np.cumsum(edge[:n]) > 0
