import random
import re

import numpy as np
import xxhash
from llm_cases import CLASHES, SF, awkward, empty, prose

from trapline.llm import queries, simhash
from trapline.llm.components import component_roots


def slow_fingerprint(text, n=4):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_classes(rows, n=4, radius=4):
    prints = [slow_fingerprint(t, n) for _, t in rows]
    group = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (prints[i] ^ prints[j]).bit_count() <= radius and group[j] < group[i]:
                    group[i], changed = group[j], True
    least = {}
    for (d, _), g in zip(rows, group):
        if d is not None:
            least[g] = min(least.get(g, d), d)
    slow_classes.found = len(set(group))
    return [(d, f"{p:016x}", least.get(g)) for (d, _), p, g in zip(rows, prints, group)]


def test_query_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in queries.op5_simhash_near_dedup(spark, SF).collect()]
    assert sorted(got) == sorted(slow_classes(rows))


def test_awkward_rows(spark):
    docs = awkward(spark, CLASHES)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = [(r["doc_id"], f"{r['fp'] % 2**64:016x}", r["component_id"]) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=repr) == sorted(slow_classes(rows), key=repr)


def test_keep_one_of_each_class(spark):
    docs = awkward(spark, CLASHES)
    kept = simhash.keep_one(docs).collect()
    classes = slow_classes([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert len(kept) == slow_classes.found
    assert {r["doc_id"] for r in kept} == {c for _, _, c in classes}
    assert simhash.keep_one(docs).columns == docs.columns


def test_tile_forest_spans_all_links():
    rng = np.random.default_rng(1)
    seeds = rng.integers(0, 2**63, 20).astype(np.uint64)
    x = np.unique(np.concatenate([seeds ^ (np.uint64(1) << rng.integers(0, 64, 20).astype(np.uint64)) for _ in range(6)]))
    a, b = simhash.tile_forest(x, x, 4)
    assert len(a) < len(x)
    parent = {int(v): int(v) for v in x}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, j in zip(a.tolist(), b.tolist()):
        parent[root(i)] = root(j)
    for i in x.tolist():
        for j in x.tolist():
            if (i ^ j).bit_count() <= 4:
                assert root(i) == root(j)


def test_many_tiles_give_the_same_classes(spark):
    rng = random.Random(2)
    base = [prose(40, i, 500) for i in range(30)]
    rows = [(i, rng.choice(base) if i % 3 else prose(40, 1000 + i, 500)) for i in range(150)]
    marks = simhash.fingerprint(spark.createDataFrame(rows, "doc_id long, text string"), 4).select("fp").distinct()
    few = {tuple(sorted(r)) for r in component_roots(simhash.links(marks, 20)).collect()}
    many = {tuple(sorted(r)) for r in component_roots(simhash.links(marks, 20, tile_rows=3)).collect()}
    assert few == many and few


def test_long_chain_is_one_component(spark):
    order = list(range(200))
    random.Random(4).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(199)] + [(500, 501), (7, 7)], "a long, b long")
    roots = {r["node"]: r["root"] for r in component_roots(edges).collect()}
    assert roots == {i: 0 for i in range(200)} | {500: 500, 501: 500}


def test_empty(spark):
    assert simhash.near_duplicates(empty(spark)).collect() == []
    assert simhash.keep_one(empty(spark)).collect() == []
