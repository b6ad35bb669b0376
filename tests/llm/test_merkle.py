import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from llm_cases import CLASHES, DOCS, awkward, empty

from trapline.llm import merkle, oracle, ordering, queries
from trapline.llm.shipping import prepare
from trapline.session import scratch_path

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(level):
    """The root, and each leaf's siblings per level."""
    proofs, own = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for p, k in enumerate(own):
            first = k // 3 * 3
            proofs[p].append((level[first:k], level[k + 1 : first + 3]))
            own[p] = k // 3
        level = [digest(*level[i : i + 3]) for i in range(0, len(level), 3)]
    return level[0], proofs


def slow(rows):
    by, subs, proofs = {}, {}, {}
    for i, r in enumerate(rows):
        by.setdefault(r["source"], []).append((r["doc_id"], leaf_of(r, r["text"]), i))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        own = sorted(by[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        subs[s], paths = climb([x[1] for x in own])
        proofs |= {x[2]: (x[1], p) for x, p in zip(own, paths)}
    root, top = climb([subs[s] for s in names]) if names else (None, [])
    for i, r in enumerate(rows):
        leaf, path = proofs[i]
        path = path + top[names.index(r["source"])]
        text = r["text"]
        if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and text is not None:
            text = text.replace("\n", "")
        folded = leaf_of(r, text)
        for left, right in path:
            folded = digest(*left, folded, *right)
        yield r["doc_id"], leaf, subs[r["source"]], root, digest(*(x for left, right in path for x in left + right)), folded, folded == root


def sorted_rows(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def run_query(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_merkle_manifest(spark, str(tmp_path))
    assert got.columns == COLUMNS
    return got.collect()


@pytest.mark.parametrize("levels", range(1, 8))
def test_layout_is_a_van_emde_boas_order(levels):
    place = merkle.addresses(levels)
    assert sorted(np.concatenate(place).tolist()) == list(range(merkle.size(levels)))

    def laid(nodes, height):  # the definition, node by node
        if height == 1:
            return [nodes[0]]
        upper = height // 2
        below = [(nodes[0][0] + upper, nodes[0][1] * 3**upper + j) for j in range(3**upper)]
        out = laid(nodes, upper)
        for b in below:
            out += laid([b], height - upper)
        return out

    order = laid([(0, 0)], levels)
    assert [int(place[d][i]) for d, i in order] == list(range(len(order)))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28, 81])
def test_block_against_plain_levels(n):
    leaves = [digest(str(i)) for i in range(n)]
    height = merkle.lone_height(n)
    nodes = merkle.grow(np.frombuffer(bytes.fromhex("".join(leaves)), np.uint8).reshape(-1, 32), height)
    root, paths = climb(leaves)
    assert nodes[0].tobytes().hex() == root
    left, right = merkle.siblings(nodes, n, height, np.arange(n))
    for i, path in enumerate(paths):
        assert [(l[i].hex(), r[i].hex()) for l, r in zip(left, right)] == [("".join(l), "".join(r)) for l, r in path]


def test_awkward_rows(spark, tmp_path):
    docs = awkward(spark, CLASHES)
    docs = docs.unionByName(docs.where("doc_id = 5")).unionByName(spark.createDataFrame([(20 + i, f"a\nb {i}\n", "en", "ü" if i % 2 else "z", i) for i in range(30)], DOCS).selectExpr("*", *[f"'own' AS {c}" for c in CLASHES]))
    assert sorted_rows(run_query(spark, docs, tmp_path)) == sorted_rows(slow(docs.select("doc_id", "text", "lang", "source", "n_chars").collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT doc_id, text, lang, source, n_chars FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = con.execute(oracle.OP13_SQL)
    assert [c[0] for c in found.description] == COLUMNS
    assert sorted_rows(found.fetchall()) == sorted_rows(slow(docs.select("doc_id", "text", "lang", "source", "n_chars").collect()))


def test_empty(spark, tmp_path):
    assert run_query(spark, empty(spark), tmp_path) == []


@pytest.mark.parametrize("height", [1, 2])
def test_many_rounds_and_a_hot_tree(spark, height):
    """Small blocks, so that trees and the tree over them take several rounds; one tree holds half the rows."""
    prepare(spark)
    rows = [(i, f"s{i % 40}" if i % 2 else "hot", "x", i, f"t{i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    fields = [docs[c] for c in ("doc_id", "source", "lang", "n_chars", "text")]
    leaves = docs.select(ordering.group_key("source").alias("tree"), "doc_id", merkle.digest_of(fields).alias("digest"))
    path = scratch_path(spark, "merkle-test")
    manifest = merkle.build(leaves, path, ["doc_id"], height=height)
    assert len(manifest.trees) > 2 and len(manifest.top) > 1
    proved = merkle.prove(spark, manifest, path, ["doc_id", "digest"])
    proved = proved.select("doc_id", merkle.proof_digest(proved["left"], proved["right"]), merkle.fold(proved["digest"], proved["left"], proved["right"]))
    wanted = {r[0]: r for r in slow([dict(zip(("doc_id", "source", "lang", "n_chars", "text"), r)) for r in rows])}
    root = manifest.root(spark).hex()
    got = proved.collect()
    assert len(got) == 400
    for doc_id, proof, folded in got:
        assert (root, proof, folded) == (wanted[doc_id][3], wanted[doc_id][4], root)


def test_places_of_a_group_over_many_partitions(spark):
    """Equal rows by the hundred: places are gapless, and no partition holds the group alone."""
    rows = spark.range(900).selectExpr("CASE WHEN id < 600 THEN 'hot' ELSE concat('g', id % 7) END AS g", "0 AS k")
    placed = ordering.placed(rows, "g", [rows["k"]])
    found = ordering.numbered(placed, "g").collect()
    by = {}
    for r in found:
        by.setdefault(r["g"], []).append(r["_pos"])
    assert {g: sorted(p) for g, p in by.items()} == {g: list(range(len(p))) for g, p in by.items()}
    assert len({r["_part"] for r in found if r["g"] == "hot"}) > 2


