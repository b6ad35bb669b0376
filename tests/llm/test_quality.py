import random

import numpy as np
import pyarrow as pa
from llm_cases import CLASHES, SF, awkward, empty, prose

from trapline.llm import common, quality, queries


def labelled(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        text = ". ".join(prose(rng.randrange(5, 15), seed * 1000 + i * 10 + k, 3000).capitalize() for k in range(rng.randrange(3, 9)))
        kind = rng.randrange(8)
        if kind == 0:
            text = text.upper().replace(" ", "!! ")
        elif kind == 1:
            text = " ".join(w for x in text.split()[:6] for w in [x] * 12)
        elif kind == 2:
            text = text.replace(" ", " | ")
        out.append((text, int(kind > 2)))
    return out


def model_of(rows):
    texts, labels = [t for t, _ in rows], [y for _, y in rows]
    raw, off = common.flat(pa.array(texts, pa.large_string()))
    df = sum((b > 0).sum(axis=0) for _, _, b in quality.counts(raw, off))
    return quality.fit(texts, labels, np.log((1 + len(texts)) / (1 + df)) + 0.1, float(np.mean(labels)))


def votes(model, texts):
    raw, off = common.flat(pa.array(texts, pa.large_string()))
    return np.concatenate([model.vote(b) for _, _, b in quality.counts(raw, off)])


def test_held_out_accuracy():
    model, test = model_of(labelled(400, 1)), labelled(200, 2)
    got = votes(model, [t for t, _ in test]) >= 0.3
    assert (got == np.array([y for _, y in test], bool)).mean() >= 0.97


def test_vote_against_brute_force():
    model, test = model_of(labelled(90, 1)), [t for t, _ in labelled(20, 3)]
    raw, off = common.flat(pa.array(test, pa.large_string()))
    for _, _, block in quality.counts(raw, off):
        x = model.latent(block)
        for row, got in zip(x, model.vote(block)):
            near = model.vectors @ row
            best = sorted(range(len(near)), key=lambda i: (-near[i], i))[: quality.NEIGHBOURS]
            w = np.maximum(near[best], 0) * model.weights[best]
            assert abs(got - (w * model.labels[best]).sum() / w.sum()) < 1e-5


def test_blocks_do_not_change_counts():
    texts = [t for t, _ in labelled(600, 4)] + ["", "x"]
    raw, off = common.flat(pa.array(texts, pa.large_string()))
    whole = np.concatenate([b for _, _, b in quality.counts(raw, off)])
    for i in (0, 255, 256, 599, 600, 601):
        one = texts[i].encode()
        assert (next(quality.counts(np.frombuffer(one, np.uint8), np.array([0, len(one)])))[2][0] == whole[i]).all()


def test_one_label_or_none():
    idf = np.ones(quality.TERMS)
    assert votes(quality.fit([], [], idf, 0.5), ["a", ""]).tolist() == [0.5, 0.5]
    assert votes(quality.fit(["a", "b"], [1, 1], idf, 1.0), ["a"]).tolist() == [1.0]


def test_awkward_rows(spark):
    model = model_of(labelled(100, 1))
    rows = quality.score(awkward(spark, CLASHES), model).collect()
    assert len(rows) == 16 and all(0 <= r["score"] <= 1 for r in rows)
    assert all(abs(r["score"] - model.prior) < 1e-9 for r in rows if not r["text"])
    assert quality.score(empty(spark), model).collect() == []


def test_query(spark):
    import zlib

    rows = queries.op9_quality(spark, SF).collect()
    assert len(rows) == 200
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_held_out_quality_on_a_real_table(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op9_quality(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").groupBy("quality", "predicted").count().collect()
    n = {(r["quality"], r["predicted"]): r["count"] for r in got}
    assert n[1, 1] >= 0.98 * (n[1, 1] + n.get((1, 0), 0))
    assert n.get((0, 1), 0) <= 0.1 * n[0, 0]
