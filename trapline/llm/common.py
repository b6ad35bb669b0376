"""Text helpers for Arrow tasks: whole columns as flat byte arrays, word spans, hashes."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: fixed values: the ASCII blanks that part words
BLANKS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: text bytes worked on at once (a longer text is a slice of its own)
SLICE_BYTES = 1 << 18

#: which bytes make words: all but the blanks; or letters, digits and whatever is no ASCII
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[list(BLANKS)] = False
LETTERS = np.array([chr(i).isalnum() if i < 128 else True for i in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: a random-looking 64-bit value for each byte
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            for name, b in (("up", self.base), ("down", self.inverse)):
                row = np.full(n, b, np.uint64)
                row[0] = 1
                setattr(self, name, np.cumprod(row, dtype=np.uint64))
        return self.up, self.down


FIRST, SECOND = Powers(0x9E3779B97F4A7C15), Powers(0xD6E8FEB86659FD93)


class Prefix:
    """Hashes of any span of a sequence of 64-bit units, from one prefix sum."""

    def __init__(self, units: np.ndarray, powers: Powers = FIRST):
        up, self.down = powers.to(len(units) + 1)
        self.sums = np.zeros(len(units) + 1, np.uint64)
        np.cumsum(units * up[: len(units)], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n])


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and row offsets (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = pc.fill_null(column.cast(kind), b"" if kind == pa.large_binary() else "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off


def slices(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def word_spans(raw: np.ndarray, off: np.ndarray, kind: np.ndarray = NOT_BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in ``raw``, and each row's offsets into the words.

    A word is a run of bytes of a kind; rows part words too.
    ``off`` starts at 0.
    """
    word = kind[raw]
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, off)


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return Prefix(BYTE_VALUES[raw]).spans(start, end) if len(start) else np.zeros(0, np.uint64)


def signed(x: np.ndarray) -> np.ndarray:
    """uint64 as Spark's long, bit for bit."""
    return x.view(np.int64)


def joined(raw: np.ndarray, start: np.ndarray, end: np.ndarray, gap: int = 0x20) -> tuple[np.ndarray, np.ndarray]:
    """The spans' bytes in a row, each followed by ``gap``; and where each span begins there."""
    size = end - start + 1
    at = np.zeros(len(start) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    source = np.repeat(start - at[:-1], size) + np.arange(at[-1])
    out = raw[np.minimum(source, len(raw) - 1)] if len(raw) else np.zeros(0, np.uint8)
    out[at[1:] - 1] = gap
    return out, at


def give_back() -> None:
    """Return freed memory to the system: Python workers stay alive between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def add_columns(docs: DataFrame, work: Callable[[np.ndarray, np.ndarray], dict[str, pa.Array]], added: dict[str, str]) -> DataFrame:
    """``docs`` with columns worked out from slices of its texts.

    ``work`` gets a slice's bytes and row offsets (from 0). Columns of ``docs`` that
    clash with the added ones are replaced.
    """
    kept = [c for c in docs.columns if c.lower() not in added]
    rows = docs.select(*[F.col(c).cast("string").alias(c) if c == "text" else F.col(c) for c in kept])

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            raw, off = flat(batch.column("text"))
            for lo, hi in slices(off):
                new = work(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, *(new[c] for c in added)], names=[*kept, *added])
        give_back()

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + [f"{c} {kind}" for c, kind in added.items()]
    return rows.mapInArrow(batches, ", ".join(schema))
