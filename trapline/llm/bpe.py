"""SentencePiece byte-pair encoding and decoding by vectorised merge rounds.

The model file only supplies pieces and scores. A text gets a leading blank
mark and its blanks become marks; it is cut where no piece holds the two
characters side by side (so before every word), and equal words of a batch are
encoded once. The words' symbols lie in flat numpy arrays. A round looks up the
piece of every adjacent pair, takes each word's best pair (highest score, then
leftmost) by a segmented minimum, merges it in all words at once, and compacts
the arrays; words without a pair leave. Only one pair a word merges in a round,
which is the library's own order whatever the scores. A symbol that is no piece
becomes its UTF-8 byte pieces.

A word of more than ``LONG_WORD`` symbols would need as many rounds as merges;
such words go through the same rounds on a heap of pairs instead, which keeps
the cost near linear in their length. Both give the same pieces.

Defined cases: a null text is empty and has no ids; texts of any length are
encoded whole; repeated texts, ties and other columns need no care, rows are
encoded one by one; an empty table gives no rows. In decoding a null list is an
empty text, byte pieces that are no UTF-8 give U+FFFD, control ids give nothing.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# fixed values of the model format
MARK = "▁"
UNKNOWN_SURFACE = " ⁇ "

LONG_WORD = 512
#: words kept between batches, and symbols encoded at once
CACHED_WORDS = 200_000
ROUND_SYMBOLS = 1 << 20
NONE = np.int32(2**31 - 1)


class PairTable:
    """A hash table in flat arrays from a pair of symbols to (rank, merged symbol)."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, np.uint64(2**64 - 1)), np.zeros(1 << bits, np.int32)
        self.reach, left = 0, np.arange(len(keys))
        at = self._home(keys)
        while len(left):  # linear probing: of the keys at a free place the first stays, the others go on
            free = self.keys[at] == np.uint64(2**64 - 1)
            places, first = np.unique(np.where(free, at, -1), return_index=True)
            first = first[places >= 0]
            self.keys[at[first]], self.values[at[first]] = keys[left[first]], values[left[first]]
            rest = np.ones(len(left), bool)
            rest[first] = False
            left, at = left[rest], (at[rest] + 1) & self.mask
            self.reach += 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, or NONE."""
        out, at, left = np.full(len(keys), NONE), self._home(keys), np.arange(len(keys))
        for _ in range(self.reach):
            there = self.keys[at]
            hit = there == keys[left]
            out[left[hit]] = self.values[at[hit]]
            go = ~hit & (there != np.uint64(2**64 - 1))
            left, at = left[go], (at[go] + 1) & self.mask
            if not len(left):
                break
        return out


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)


class Model:
    """Pieces, merge ranks and the characters that may stand side by side in a piece.

    Symbols below ``size`` are piece ids; a character that is no piece is
    ``size`` plus its code point.
    """

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n)]
        self.unknown = sp.unk_id()
        self.byte_ids = np.full(256, self.unknown, np.int32)
        self.surface = [b""] * n
        for i, piece in enumerate(pieces):
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.surface[i] = bytes([int(piece[3:5], 16)])
            elif plain[i]:
                self.surface[i] = piece.replace(MARK, " ").encode()
        self.surface[self.unknown] = UNKNOWN_SURFACE.encode()
        self.is_byte = np.array([sp.is_byte(i) for i in range(n)])
        self.starts_blank = np.array([plain[i] and pieces[i].startswith(MARK) for i in range(n)])
        ids = {p: i for i, p in enumerate(pieces) if plain[i]}
        # equal scores share a rank, so that the leftmost of them goes first
        scores = sorted({sp.get_score(i) for i in ids.values()}, reverse=True)
        rank_of = {s: r for r, s in enumerate(scores)}
        self.rank = np.array([rank_of[sp.get_score(i)] if plain[i] else NONE for i in range(n)], np.int32)
        symbol = lambda t: ids.get(t, n + ord(t) if len(t) == 1 else None)
        pairs, beside = {}, set()
        for piece, i in ids.items():
            for k in range(1, len(piece)):
                beside.add((ord(piece[k - 1]), ord(piece[k])))
                a, b = symbol(piece[:k]), symbol(piece[k:])
                if a is not None and b is not None:
                    pairs[a, b] = i
        self.pairs = pairs
        ab = np.array(list(pairs), np.int64).reshape(-1, 2)
        self.table = PairTable(_pair(ab[:, 0], ab[:, 1]), np.array(list(pairs.values()), np.int32))
        cc = np.array(sorted(beside), np.int64).reshape(-1, 2)
        self.beside = PairTable(_pair(cc[:, 0], cc[:, 1]), np.zeros(len(cc), np.int32))
        self.of_char = np.arange(0x110000, dtype=np.int32) + n
        for p, i in ids.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        self.surface_bytes = np.frombuffer(b"".join(self.surface), np.uint8)
        self.surface_at = np.zeros(n + 1, np.int64)
        np.cumsum([len(s) for s in self.surface], out=self.surface_at[1:])

    def merge(self, symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds over words; ``first`` marks each word's first symbol.

        Returns the final symbols and, for each, the place of its first character.
        """
        place = np.arange(len(symbols))
        done_symbols, done_places = [], []
        merged = self._lookup(symbols, first)
        while True:
            word = np.cumsum(first) - 1
            heads = np.flatnonzero(first)
            key = np.where(merged == NONE, np.iinfo(np.int64).max, (self.rank[np.minimum(merged, self.size - 1)].astype(np.int64) << 32) | np.arange(len(symbols)))
            best = np.minimum.reduceat(key, heads) if len(heads) else key[:0]
            live = best != np.iinfo(np.int64).max
            if not live.all():  # compaction: words without a pair leave
                keep = live[word]
                done_symbols.append(symbols[~keep])
                done_places.append(place[~keep])
                shift = np.cumsum(keep) - 1
                symbols, place, first, merged = symbols[keep], place[keep], first[keep], merged[keep]
                best = shift[best[live] & 0xFFFFFFFF]
            else:
                best = best & 0xFFFFFFFF
            if not len(symbols):
                break
            symbols[best] = merged[best]
            keep = np.ones(len(symbols), bool)
            keep[best + 1] = False
            symbols, place, first, merged = symbols[keep], place[keep], first[keep], merged[keep]
            at = best - np.arange(len(best))  # one symbol went in every word before
            # only the pairs beside a merge are new
            self._relook(symbols, first, merged, at)
        symbols, place = np.concatenate(done_symbols), np.concatenate(done_places)
        order = np.argsort(place, kind="stable")
        return symbols[order], place[order]

    def _lookup(self, symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
        out = np.full(len(symbols), NONE)
        inner = np.flatnonzero(~first[1:])
        out[inner] = self.table.find(_pair(symbols[inner], symbols[inner + 1]))
        return out

    def _relook(self, symbols: np.ndarray, first: np.ndarray, merged: np.ndarray, at: np.ndarray) -> None:
        merged[at] = NONE
        right = at[at + 1 < len(symbols)]
        right = right[~first[right + 1]]
        merged[right] = self.table.find(_pair(symbols[right], symbols[right + 1]))
        left = at[~first[at]] - 1
        merged[left] = self.table.find(_pair(symbols[left], symbols[left + 1]))

    def merge_long(self, symbols: list[int]) -> list[tuple[int, int]]:
        """The same merges of one long word on a heap: ``(symbol, place)``."""
        n = len(symbols)
        left, right, heap = list(range(-1, n - 1)), list(range(1, n + 1)), []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < n and (m := self.pairs.get((symbols[a], symbols[b]))) is not None:
                heapq.heappush(heap, (int(self.rank[m]), a, b, symbols[a], symbols[b], m))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, was_a, was_b, m = heapq.heappop(heap)
            if symbols[a] != was_a or symbols[b] != was_b or right[a] != b:
                continue
            symbols[a], symbols[b] = m, -1
            right[a] = right[b]
            if right[b] < n:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [(s, i) for i, s in enumerate(symbols) if s >= 0]

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each word (a word holds its own leading marks)."""
        out: list[np.ndarray] = []
        lo = 0
        while lo < len(words):
            hi, n = lo, 0
            while hi < len(words) and (hi == lo or n < ROUND_SYMBOLS):
                n += len(words[hi])
                hi += 1
            out += self._encode_some(words[lo:hi])
            lo = hi
        return out

    def _encode_some(self, words: list[str]) -> list[np.ndarray]:
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.zeros(len(words) + 1, np.int64)
        np.cumsum([len(w) for w in words], out=at[1:])
        first = np.zeros(len(chars), bool)
        first[at[:-1]] = True
        # no piece holds these two characters side by side: nothing merges across
        first[1:] |= self.beside.find(_pair(chars[:-1], chars[1:])) == NONE
        symbols = self.of_char[chars]
        heads = np.flatnonzero(first)
        size = np.diff(np.append(heads, len(chars)))
        long = np.flatnonzero(size > LONG_WORD)
        if len(long):
            short = np.repeat(size <= LONG_WORD, size)
            kept = np.flatnonzero(short)
            s, p = self.merge(symbols[kept], first[kept]) if len(kept) else (symbols[:0], kept)
            parts_s, parts_p = [s], [kept[p]]
            for k in long:
                found = self.merge_long(symbols[heads[k] : heads[k] + size[k]].tolist())
                parts_s.append(np.array([x for x, _ in found], np.int32))
                parts_p.append(np.array([i for _, i in found]) + heads[k])
            symbols, place = np.concatenate(parts_s), np.concatenate(parts_p)
            order = np.argsort(place, kind="stable")
            symbols, place = symbols[order], place[order]
        else:
            symbols, place = self.merge(symbols, first)
        cut = np.searchsorted(place, at)
        if (symbols >= self.size).any():  # characters that are no piece: their bytes
            whole, counts = [], np.ones(len(symbols), np.int64)
            for i in np.flatnonzero(symbols >= self.size):
                raw = chr(int(symbols[i]) - self.size).encode("utf-8", "replace")
                counts[i] = len(raw)
                whole.append(self.byte_ids[np.frombuffer(raw, np.uint8)])
            spread = np.repeat(symbols, counts)
            spread[np.repeat(symbols >= self.size, counts)] = np.concatenate(whole)
            ends = np.zeros(len(symbols) + 1, np.int64)
            np.cumsum(counts, out=ends[1:])
            symbols, cut = spread, ends[cut]
        return np.split(symbols.astype(np.int32), cut[1:-1])

    def decode_rows(self, ids: np.ndarray, off: np.ndarray) -> list[str]:
        """The text of each row of ids (``off`` starts at 0)."""
        size = self.surface_at[ids + 1] - self.surface_at[ids]
        ends = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(size, out=ends[1:])
        source = np.repeat(self.surface_at[ids] - ends[:-1], size) + np.arange(ends[-1])
        data = self.surface_bytes[source].tobytes()
        out = []
        for a, b in zip(off[:-1], off[1:]):
            lo = ends[a]
            if a < b and self.starts_blank[ids[a]]:
                lo += 1  # the mark that encoding put before the text
            out.append(data[lo : ends[b]].decode("utf-8", "replace"))
        return out


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


def split_words(text: str) -> list[str]:
    """The marked text cut before each run of marks."""
    if not text:
        return []
    words, run = [], MARK
    for part in text.replace(MARK, " ").split(" "):
        if part:
            words.append(run + part)
            run = MARK
        else:
            run += MARK
    if len(run) > 1:
        words.append(run[1:])
    return words


class Encoder:
    """Encodes texts, keeping the ids of words met before in one flat array."""

    def __init__(self, path: str):
        self.model = model(path)
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.flat, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _learn(self, words: list[str]) -> None:
        ids = self.model.encode_words(words)
        self.number.update(zip(words, range(len(self.number), len(self.number) + len(words))))
        self.at = np.append(self.at, self.at[-1] + np.cumsum([len(x) for x in ids]))
        self.flat = np.concatenate([self.flat, *ids])

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and each text's offsets."""
        rows = [split_words(t) for t in texts]
        if len(self.number) > CACHED_WORDS:
            self._forget()
        number = self.number
        if new := list({w: None for row in rows for w in row if w not in number}):
            self._learn(new)
        word = np.fromiter((number[w] for row in rows for w in row), np.int64)
        size = self.at[word + 1] - self.at[word]
        ends = np.zeros(len(word) + 1, np.int64)
        np.cumsum(size, out=ends[1:])
        ids = self.flat[np.repeat(self.at[word] - ends[:-1], size) + np.arange(ends[-1])]
        words = np.zeros(len(rows) + 1, np.int64)
        np.cumsum([len(row) for row in rows], out=words[1:])
        return ids, ends[words]


def _encode_batches(batches: Iterator[pa.RecordBatch], path: str, text_at: int) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(path)
    for batch in batches:
        raw, off = common.flat(batch.column(text_at))
        for lo, hi in common.slices(off):
            data = raw[off[lo] : off[hi]].tobytes()
            ids, at = encoder([data[a:b].decode("utf-8", "replace") for a, b in zip(off[lo:hi] - off[lo], off[lo + 1 : hi + 1] - off[lo])])
            part = batch.slice(lo, hi - lo)
            columns = [c for i, c in enumerate(part.columns) if i != text_at]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))],
                names=[*(n for i, n in enumerate(part.schema.names) if i != text_at), "ids"],
            )


def encode(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """``docs`` with its text replaced by ``ids`` (a column ``ids`` of the input is dropped)."""
    docs = docs.select(*[c for c in docs.columns if c.lower() != "ids"])
    docs = docs.withColumn(text, F.coalesce(F.col(text).cast("string"), F.lit("")))
    at = docs.columns.index(text)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text), "ids array<int>"])
    return docs.mapInArrow(lambda it: _encode_batches(it, model_path, at), schema)


def round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """``docs`` with the ``ids`` of its text, and ``decoded``, the text decoded from those ids.

    The same as ``encode`` and ``decode``, by one Python worker a task.
    """

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model_path)
        for batch in found:
            raw, off = common.flat(batch.column("text"))
            for lo, hi in common.slices(off):
                data = raw[off[lo] : off[hi]].tobytes()
                ids, at = encoder([data[a:b].decode("utf-8", "replace") for a, b in zip(off[lo:hi] - off[lo], off[lo + 1 : hi + 1] - off[lo])])
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
                texts = pa.array(encoder.model.decode_rows(ids, at), pa.string())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in kept), lists, texts], names=[*kept, "ids", "decoded"])
        del encoder
        common.give_back()

    kept = [c for c in docs.columns if c.lower() not in ("ids", "decoded")]
    rows = docs.select(*[F.col(c).cast("string").alias(c) if c == "text" else F.col(c) for c in kept])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "ids array<int>", "decoded string"])
    return rows.mapInArrow(batches, schema)


def _decode_batches(batches: Iterator[pa.RecordBatch], path: str, ids_at: int) -> Iterator[pa.RecordBatch]:
    found = model(path)
    for batch in batches:
        lists = batch.column(ids_at)
        off, flat = np.asarray(lists.offsets, np.int64), np.asarray(lists.values, np.int32)
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + (1 << 19), side="right")) - 1)
            hi = min(hi, batch.num_rows)
            texts = found.decode_rows(flat[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            part = batch.slice(lo, hi - lo)
            columns = [c for i, c in enumerate(part.columns) if i != ids_at]
            names = [n for i, n in enumerate(part.schema.names) if i != ids_at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], names=[*names, "decoded"])
            lo = hi


def decode(rows: DataFrame, model_path: str, ids: str = "ids") -> DataFrame:
    """``rows`` with its list of ids replaced by the text ``decoded`` (a column of that name is dropped)."""
    rows = rows.select(*[c for c in rows.columns if c.lower() != "decoded"])
    rows = rows.withColumn(ids, F.coalesce(F.col(ids), F.array().cast("array<int>")))
    at = rows.columns.index(ids)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != ids), "decoded string"])
    return rows.mapInArrow(lambda it: _decode_batches(it, model_path, at), schema)
