import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from llm_cases import CLASHES, awkward, empty

from trapline.llm import common, jaccard, oracle, queries, shingles, spread
from trapline.llm.shipping import prepare

COLUMNS = ["doc_id", "n_shingles", "component_id"]


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def shingle_set(text):
    w = words_of(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def slow_links(sets):
    places, links = defaultdict(list), []
    for k, s in enumerate(sets):
        shared = Counter(j for t in s for j in places[t])
        links += [(j, k) for j, o in shared.items() if 100 * o >= 80 * (len(s) + len(sets[j]) - o)]
        for t in s:
            places[t].append(k)
    return links


def slow(rows):
    classes = defaultdict(list)
    for doc_id, text in rows:
        classes[shingle_set(text)].append(doc_id)
    sets = [s for s in classes if s]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in slow_links(sets):
        root[find(a)] = find(b)
    ids = defaultdict(list)
    for k, s in enumerate(sets):
        ids[find(k)] += [i for i in classes[s] if i is not None]
    component = {s: min(ids[find(k)], default=None) for k, s in enumerate(sets)}
    return [(i, len(s), component[s] if s else i) for i, s in ((i, shingle_set(t)) for i, t in rows)]


def sorted_rows(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def check(spark, docs, tmp_path, sql=True):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    wanted = sorted_rows(slow([tuple(r) for r in docs.select("doc_id", "text").collect()]))
    got = queries.op12_jaccard_join(spark, str(tmp_path))
    assert got.columns == COLUMNS
    assert sorted_rows(got.collect()) == wanted
    if sql:
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        assert sorted_rows(con.execute(oracle.OP12_SQL).fetchall()) == wanted
    return wanted


def test_awkward_rows(spark, tmp_path):
    docs = awkward(spark, CLASHES)
    check(spark, docs.unionByName(docs.where("doc_id IN (2, 5)")), tmp_path)


def test_empty(spark, tmp_path):
    assert check(spark, empty(spark), tmp_path) == []


def edited(words, share, rng):
    return [f"new{rng.randrange(10**9)}" if rng.random() < share else w for w in words]


@pytest.mark.parametrize("seed", [1])
def test_chains_copies_and_borders(spark, tmp_path, seed):
    """Groups linked only through others, sets just at and just below the bound, copies by the dozen."""
    prepare(spark)
    rng, rows = random.Random(seed), []
    for g in range(25):
        text = [f"g{g}w{rng.randrange(60)}" for _ in range(rng.randrange(5, 150))]
        for _ in range(rng.randrange(1, 14)):
            rows.append(" ".join(text))
            if rng.random() < 0.3:
                rows += [" ".join(text).upper()] * rng.randrange(1, 10)
            text = edited(text, rng.choice([0.0, 0.01, 0.02, 0.04]), rng)
    for n in range(5, 60):  # shared shingles stand exactly at the bound for many sizes
        base = [f"b{n}x{i}" for i in range(n)]
        rows += [" ".join(base), " ".join([*base, *(f"c{n}y{i}" for i in range((n - 4) // 4))]), " ".join([*base, *(f"d{n}y{i}" for i in range((n - 4) // 4 + 1))])]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i * 7 % 100_003, t) for i, t in enumerate(rows)], "doc_id long, text string").repartition(6)
    check(spark, docs, tmp_path)


def test_hot_groups(spark, tmp_path, monkeypatch):
    """A near-copy group holds most rows: shingles of many sets go the sample's way, pairs are made with leaders."""
    prepare(spark)
    monkeypatch.setattr(spread, "LEAST", 20)
    monkeypatch.setattr(jaccard, "SAMPLE", 2)
    rng = random.Random(3)
    base, other = [f"w{i}" for i in range(120)], [f"v{i}" for i in range(120)]
    rows = [" ".join(edited(base, rng.choice([0.005, 0.02, 0.03]), rng)) for _ in range(400)] + [" ".join(base)] * 100
    # sets that share a long passage with the group and with each other, but are linked with none
    rows += [" ".join(base[:70] + [f"o{k}y{i}" for i in range(60)]) for k in range(40)]
    rows += [" ".join(edited(base[:60] + other[:60], 0.01, rng)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(6)
    check(spark, docs, tmp_path)


def test_all_pairs_without_leaders(spark, tmp_path, monkeypatch):
    """Without leaders all pairs of a shingle are looked at."""
    prepare(spark)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(80)]
    rows = [" ".join(edited(base, 0.02, rng)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    monkeypatch.setattr(jaccard, "MANY", 10**9)
    monkeypatch.setattr(jaccard, "_led_pairs", lambda entries, *_: entries.where("false").selectExpr("key AS a", "key AS b"))
    check(spark, docs, tmp_path / "all", sql=False)


def test_scouts_leave_no_link_out():
    """Linked sets share at least as many scouts as either is asked for."""
    rng = random.Random(4)
    for _ in range(400):
        n = rng.randrange(1, 60)
        a = {rng.randrange(1 << 40) for _ in range(n)}
        b = set(rng.sample(sorted(a), max(1, n - rng.randrange(0, n // 5 + 1)))) | {rng.randrange(1 << 40) for _ in range(rng.randrange(0, n // 5 + 1))}
        if 100 * len(a & b) < 80 * len(a | b):
            continue
        picked = []
        for s in (a, b):
            values = np.array(sorted(s), np.uint64)
            found, _ = jaccard._scouts(values, np.array([0, len(values)]), 80)
            picked.append(set(values[found].tolist()))
        for s in (a, b):
            least = -(-jaccard._need(len(s), 80) // 10)
            assert len(picked[0] & picked[1]) >= least


def test_hashes_tell_thue_morse_words_apart():
    """Words that agree under sums of powers modulo 2**64 have other hashes here."""
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    a, b = ("".join("ab"[x ^ flip] for x in bits) for flip in (0, 1))
    raw, off = np.frombuffer((a + " " + b).encode(), np.uint8), np.array([0, 4097])
    start, end, _ = common.word_spans(raw, off)
    one, two = shingles.word_hashes(raw, start, end)
    assert one != two
    units = np.where(np.array(bits + [1 - x for x in bits]) > 0, np.uint64(3), np.uint64(5)).astype(np.uint64)
    first, second = shingles.chained(units, 2048)[[0, 2048]]
    assert first != second


def test_equal_words_have_equal_hashes_wherever_they_stand():
    rng = random.Random(6)
    words = ["".join(rng.choice("abé€") for _ in range(rng.randrange(1, 40))) for _ in range(200)] * 2
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    start, end, _ = common.word_spans(raw, np.array([0, len(raw)]))
    found = shingles.word_hashes(raw, start, end)
    assert len(found) == 400 and len(set(found.tolist())) == len(set(words))
    assert (found[:200] == found[200:]).all()
