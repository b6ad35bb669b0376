import hashlib
import os
import random

import numpy as np
import pytest
from llm_cases import CLASHES, SF, as_dicts, awkward, empty, prose

from trapline.llm import common, queries, repeats, substring_dedup, suffix_dedup, winnow
from trapline.llm.suffix_sort import BlindTrie, sort_suffixes

LAST = repeats.LAST_ID


def order_id(doc_id):
    return LAST if doc_id is None else doc_id


def brute_words(rows, window):
    """Kept words of each row: windows also starting at a smaller id are removed."""
    import re

    words = [re.findall("[^\x20\x09-\x0d]+", t or "") for _, t in rows]
    least = {}
    for (d, _), w in zip(rows, words):
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            least[k] = min(least.get(k, LAST), order_id(d))
    out = []
    for (d, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < order_id(d):
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


def brute_bytes(rows, window):
    data = [(t or "").encode() for _, t in rows]
    least = {}
    for (d, _), b in zip(rows, data):
        for i in range(len(b) - window + 1):
            least[b[i : i + window]] = min(least.get(b[i : i + window], LAST), order_id(d))
    out = []
    for (d, _), b in zip(rows, data):
        gone, own = bytearray(len(b)), set()
        for i in range(len(b) - window + 1):
            k = b[i : i + window]
            if least[k] < order_id(d) or k in own:
                gone[i : i + window] = b"\1" * window
            own.add(k)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=repr)


def got_words(docs, window, seed):
    rows = substring_dedup.substring_dedup(docs, window, seed).collect()
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in rows), key=repr)


def got_bytes(docs, window, seed, **more):
    rows = suffix_dedup.suffix_dedup(docs, window, seed, **more).collect()
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept_bytes"])) for r in rows), key=repr)


def shared_texts(n, seed):
    """Documents of a few words that borrow from each other, some periodic, some with NUL bytes."""
    rng = random.Random(seed)
    texts = []
    for i in range(n):
        t = prose(rng.randrange(0, 60), seed * 100 + i, rng.choice([2, 5, 300]))
        for _ in range(rng.randrange(3)):
            if texts:
                other = rng.choice(texts)
                a = rng.randrange(0, len(other) + 1)
                t += " " * rng.randrange(2) + other[a : a + rng.randrange(0, 120)]
        if rng.random() < 0.1:
            t = "ab " * rng.randrange(50) + "\0" * rng.randrange(60)
        texts.append(t)
    return [(rng.randrange(n), t) for t in texts]  # ids repeat


@pytest.mark.parametrize("seed", [1, 2])
def test_words_against_brute_force(spark, seed):
    rows = shared_texts(60, seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got_words(docs, 5, 2) == brute_words(rows, 5)
    assert got_words(docs, 13, 5) == brute_words(rows, 13)


@pytest.mark.parametrize("seed", [3, 4])
def test_bytes_against_brute_force(spark, seed):
    rows = shared_texts(60, seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got_bytes(docs, 20, 4) == brute_bytes(rows, 20)
    assert got_bytes(docs, 20, 4, hot_blocks=2) == brute_bytes(rows, 20)  # the other way of crowded anchors


def test_salted_anchors_give_the_same(spark, monkeypatch):
    rows = shared_texts(60, 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    every = lambda rows, units, length, seed: np.array([r["anchor"] for r in repeats.block_rows(rows, units, length, seed).select("anchor").distinct().collect()], np.int64).view(np.uint64)
    monkeypatch.setattr(repeats, "heavy_anchors", every)
    assert got_words(docs, 5, 2) == brute_words(rows, 5)
    assert got_bytes(docs, 20, 4) == brute_bytes(rows, 20)


def test_awkward_rows_and_clashing_names(spark):
    docs = awkward(spark, CLASHES)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert got_words(docs, 13, 5) == brute_words(rows, 13)
    assert got_bytes(docs, 100, 16) == brute_bytes(rows, 100)
    assert {"lang", "source", "n_chars", "score"} <= set(substring_dedup.substring_dedup(docs).columns)


def test_empty(spark):
    assert substring_dedup.substring_dedup(empty(spark)).collect() == []
    assert suffix_dedup.suffix_dedup(empty(spark)).collect() == []


def test_byte_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.op4_suffix_dedup(spark, SF).collect()}
    assert got == {d: (n, g, s, hashlib.sha256(k).hexdigest()) for d, n, g, s, k in brute_bytes(rows, 100)}


@pytest.mark.parametrize("seed", range(40))
def test_deep_shallow_sort(seed):
    rng = random.Random(seed)
    letters = rng.choice([b"ab", b"a\0", b"abc\0d", bytes(range(256))])
    texts = [bytes(rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 20, 40]))) for _ in range(rng.randrange(60))]
    texts = [rng.choice(texts)[: rng.randrange(41)] + x if rng.random() < 0.6 else x for x in texts] + texts[:5]
    group = np.array([rng.randrange(4) for _ in texts], np.int64)
    size = np.array([len(x) for x in texts], np.int64)
    data = np.frombuffer(b"".join(texts) + b"z", np.uint8)
    order, shared = sort_suffixes(data, np.cumsum(size) - size, size, group)
    got = [(int(group[i]), texts[i]) for i in order]
    assert got == sorted(zip(group.tolist(), texts))
    for k, (g, x) in enumerate(got):
        assert shared[k] == (-1 if k == 0 or got[k - 1][0] != g else len(os.path.commonprefix([x, got[k - 1][1]])))


def test_blind_trie_order():
    texts = [b"banana", b"ban", b"", b"bandana", b"can", b"banan", b"ba\0"]
    order, shared = BlindTrie(texts).walk()
    assert [texts[i] for i in order] == sorted(texts)
    assert shared[1:] == [len(os.path.commonprefix([texts[a], texts[b]])) for a, b in zip(order, order[1:])]


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(3)
    units = common.mix(rng.integers(0, 3, 400).astype(np.uint64))
    off = np.array([0, 150, 150, 400])
    b = winnow.blocks(units, off, 9, 3)
    owner = {}
    for k in range(len(b.first)):
        for s in range(b.first[k], b.last[k] + 1):
            window = units[s : s + 9].tobytes()
            assert owner.setdefault(window, (b.anchor[k], b.at[k] - s)) == (b.anchor[k], b.at[k] - s)
    assert sorted(b.windows(np.ones(len(b.first), bool)).tolist()) == [*range(0, 142), *range(150, 392)]


def test_word_query_has_sql(spark):
    assert "op2_substring_dedup" in queries.oracle_sql() and as_dicts(queries.op2_substring_dedup(spark, SF))


def test_words_that_sums_of_powers_cannot_tell_apart(spark):
    """Thue-Morse words and their complements: no window of one stands in the other."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    one, two = ("".join("ab"[x ^ flip] for x in bits) for flip in (0, 1))
    tail = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{one} {tail}"), (2, f"{two} {tail}"), (3, f"{one} {tail}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.substring_dedup(docs).collect()}
    assert got == {1: 0, 2: 0, 3: 13}
