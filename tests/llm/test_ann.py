import numpy as np
from llm_cases import SF

from pyspark.sql import functions as F
from trapline.llm import ann, queries
from trapline.llm.shipping import prepare

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, wanted, k=10):
    """All usable pairs, by distance and id."""
    usable = {(i, tuple(0.0 if x == 0 else x for x in np.float32(v).tolist())) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v) and len(v) == 8}
    out = {}
    for q, v in usable:
        if wanted(q):
            near = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), i) for i, w in usable if i != q)
            out.setdefault(q, near[:k])
    return out


def got(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def vectors(n, seed, copies=0):
    rng = np.random.default_rng(seed)
    x = np.float32(rng.standard_normal((n, 8)))
    rows = [(i, x[i].tolist()) for i in range(n)]
    return rows + [(n + i, x[0].tolist()) for i in range(copies)]


def test_whole_search_is_exact_with_hot_vector_ties_and_bad_rows(spark):
    prepare(spark)
    rows = vectors(300, 1, copies=200) + [(900, None), (901, [0.0] * 8), (902, [1.0] * 7 + [None]), (903, [float("nan")] * 8), (904, [float("inf")] * 8), (905, [1.0] * 3),
                                          (None, [1.0] * 8), (910, [0.0, -0.0] + [1.0] * 6), (920, [-0.0, 0.0] + [1.0] * 6), (10, rowed := vectors(300, 1)[10][1]), (10, rowed)]
    table = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).withColumn("score", F.lit("own")).withColumn("point", F.lit(1))
    found = ann.nearest(table, F.col("vec_id") % 10 == 0, k=10, search_share=100.0, leaf_rows=16).collect()
    assert got(found) == brute(rows, lambda i: i % 10 == 0)


def test_fewer_candidates_than_k(spark):
    prepare(spark)
    rows = vectors(4, 2)
    found = ann.nearest(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA), F.col("vec_id") == 0)
    assert got(found.collect()) == brute(rows, lambda i: i == 0)


def test_empty(spark):
    prepare(spark)
    assert ann.nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") == 0).collect() == []
    assert ann.nearest(spark.createDataFrame([(1, None, 1)], SCHEMA), F.col("vec_id") == 1).collect() == []


def test_every_vector_is_in_a_leaf_that_a_full_search_visits():
    x = np.float32(np.random.default_rng(3).standard_normal((500, 16)))
    forest = ann.plant(x, 500, trees=3, leaf_rows=32)
    for t, tree in enumerate(forest.trees):
        leaves = set(tree.leaves(x).tolist())
        assert leaves <= {leaf for i, leaf in forest.search(x[0], 10**9) if i == t}
        assert (t, int(tree.leaves(x[:1])[0])) in forest.search(x[0], 3)  # its own leaves come first


def test_query_recall_and_exact_scores(spark):
    sf = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids = np.array([r["vec_id"] for r in table])
    x = np.array([r["embedding"] for r in table])
    found = got(queries.op8_nearest_neighbours(spark, sf).collect())
    hit = total = 0
    assert set(found) == {int(i) for i in ids if i % 100 == 0}
    for q, near in found.items():
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        best = sorted((float(a), int(i)) for a, i in zip(d, ids) if i != q)[:10]
        hit += len({i for _, i in best} & {i for _, i in near})
        total += 10
        assert near == sorted(near) and all(abs(s - d[ids == i][0]) < 1e-12 for s, i in near)
    assert hit >= 0.9 * total


def test_small_query(spark):
    assert len(queries.op8_nearest_neighbours(spark, SF).collect()) == 50


def test_a_block_holds_the_nearest_of_vectors_far_from_the_origin():
    rng = np.random.default_rng(5)
    for offset, spread in ((0.0, 1.0), (1e4, 0.01), (1e5, 0.01), (1e7, 0.01), (1e9, 1e-3)):
        x = rng.normal(0, spread, (600, 64)) + offset
        x = np.concatenate([x, x[:5], x[:3] + 3 * offset])  # copies and a far group
        q, m, score = ann.block_nearest(x[:40], x, 11)
        for i in range(40):
            exact = np.sqrt(((x[i] - x) ** 2).sum(axis=1))
            mine = dict(zip(m[q == i].tolist(), score[q == i].tolist()))
            edge = np.sort(exact)[10]
            assert {j for j in range(len(x)) if exact[j] <= edge} <= set(mine)
            assert all(mine[j] == exact[j] for j in mine)
            if offset < 1e7:
                assert len(mine) < 60  # room for rounding lets few others in
