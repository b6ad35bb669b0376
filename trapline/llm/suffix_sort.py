"""Deep-shallow sorting of suffixes: order, longest common prefixes, classes.

Shallow: multikey quicksort on eight bytes at a time, for all groups at once,
down to ``SHALLOW`` bytes; what differs by then is settled. Deep: every group
that still ties, suffixes with a long common prefix, goes into a blind trie, a
Patricia tree that stores only the places where suffixes part: a suffix walks
down by its bytes at those places, is compared with one leaf, and splits the
edge where it departs. Reading the trie in order gives the suffixes sorted, and
the parting places are their longest common prefixes.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 16
WORD = 8


def _common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while lo + 1 < hi:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class BlindTrie:
    """Patricia tree over byte strings; a node is ``[place, {byte: child}]``, a leaf the string's number.

    The end of a string counts as a byte below all others.
    """

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        self.root: list | int = 0
        for i in range(1, len(texts)):
            self._insert(i)

    def _insert(self, i: int) -> None:
        text, node = self.texts[i], self.root
        while not isinstance(node, int):  # blind descent: only the parting bytes are looked at
            place, children = node
            node = children.get(text[place] if place < len(text) else -1)
            if node is None:
                node = next(iter(children.values()))
        other = self.texts[node]
        depart = _common_prefix(text, other)
        parent, key, node = None, None, self.root
        while not isinstance(node, int) and node[0] < depart:
            parent, key = node, (text[node[0]] if node[0] < len(text) else -1)
            node = node[1][key]
        mine = text[depart] if depart < len(text) else -1
        if not isinstance(node, int) and node[0] == depart:
            node[1][mine] = i
            return
        theirs = other[depart] if depart < len(other) else -1
        split = [depart, {theirs: node, mine: i}]
        if parent is None:
            self.root = split
        else:
            parent[1][key] = split

    def walk(self) -> tuple[list[int], list[int]]:
        """The strings' numbers in order, and each one's common prefix with the one before (first: 0)."""
        order, shared, stack = [], [], [(self.root, 0)]
        while stack:
            node, lcp = stack.pop()
            if isinstance(node, int):
                order.append(node)
                shared.append(lcp)
                continue
            place, children = node
            ranked = sorted(children)
            stack += [(children[k], place) for k in reversed(ranked[1:])]
            stack.append((children[ranked[0]], lcp))
        return order, shared


def _words(data: np.ndarray, start: np.ndarray, size: np.ndarray, depth: int) -> np.ndarray:
    """Eight bytes of each suffix from ``depth`` on, big-endian, zero past its end."""
    out = np.zeros(len(start), np.uint64)
    for k in range(WORD):
        inside = size > depth + k
        out <<= np.uint64(8)
        out |= np.where(inside, data[np.minimum(start + depth + k, len(data) - 1)], 0).astype(np.uint64)
    return out


def sort_suffixes(data: np.ndarray, start: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes by (group, bytes), and common prefixes.

    Suffix i is ``data[start[i] : start[i] + size[i]]``. The second array has each
    suffix's common prefix with the one before it in the order, -1 where a group
    begins; equal suffixes have their whole size.
    """
    n = len(start)
    order = np.argsort(group, kind="stable")
    shared = np.full(n, -1, np.int64)
    if not n:
        return order, shared
    tied = np.zeros(n, bool)  # place i ties with place i - 1 so far
    tied[1:] = group[order][1:] == group[order][:-1]
    settled = ~tied
    for depth in range(0, SHALLOW, WORD):
        head = ~tied
        run = np.cumsum(head) - 1
        busy = np.flatnonzero(np.bincount(run)[run] > 1)
        if not len(busy):
            break
        who = order[busy]
        word = _words(data, start[who], size[who], depth)
        by = np.lexsort((word, run[busy]))
        order[busy], word = who[by], word[by]
        differ = np.zeros(len(busy), bool)
        differ[1:] = word[1:] != word[:-1]
        parted = busy[differ & tied[busy]]
        if len(parted):
            gap = word[1:] ^ word[:-1]
            gap = np.concatenate([gap[:1], gap])[differ & tied[busy]]
            same = np.zeros(len(parted), np.int64)
            for k in range(1, WORD):  # leading equal bytes
                same += gap < (np.uint64(1) << np.uint64(64 - 8 * k))
            shared[parted] = depth + same
            tied[parted] = False
            settled[parted] = True
    heads = np.flatnonzero(~tied)
    counts = np.diff(np.append(heads, n))
    raw = data.tobytes()
    for head, count in zip(heads[counts > 1].tolist(), counts[counts > 1].tolist()):
        members: dict[bytes, list[int]] = {}
        for i in order[head : head + count].tolist():
            members.setdefault(raw[start[i] : start[i] + size[i]], []).append(i)
        texts = list(members)
        ranked, lcps = BlindTrie(texts).walk()
        place = head
        for k, lcp in zip(ranked, lcps):
            equal = members[texts[k]]
            for j, i in enumerate(equal):
                order[place] = i
                if place > head:
                    shared[place] = lcp if j == 0 else len(texts[k])
                place += 1
    # a suffix past its end had zeros: no common prefix is longer than either
    inner = np.flatnonzero(shared >= 0)
    shared[inner] = np.minimum(shared[inner], np.minimum(size[order[inner]], size[order[inner - 1]]))
    return order, shared
