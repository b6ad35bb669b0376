import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import CLASHES, SF, awkward, empty, prose

from trapline.llm import common, queries, toxicity


@pytest.mark.parametrize("seed", range(5))
def test_forward_backward_against_all_paths(seed):
    rng = np.random.default_rng(seed)
    move = rng.normal(size=(2, 2))
    length = np.array([1, 4, 6])
    emit = np.zeros((3, toxicity.CHAIN))
    emit[:, :6] = rng.normal(size=(3, 6))
    marginal, moves, total = toxicity.forward_backward(emit, length, move)
    expected_moves = np.zeros((2, 2))
    for k, n in enumerate(length):
        paths = list(itertools.product((0, 1), repeat=int(n)))
        weight = [math.exp(sum(emit[k, i] for i in range(n) if p[i]) + sum(move[p[i], p[i + 1]] for i in range(n - 1))) for p in paths]
        z = sum(weight)
        assert total[k] == pytest.approx(math.log(z))
        for i in range(n):
            assert marginal[k, i] == pytest.approx(sum(w for p, w in zip(paths, weight) if p[i]) / z)
        for p, w in zip(paths, weight):
            for i in range(n - 1):
                expected_moves[p[i], p[i + 1]] += w / z
        assert (marginal[k, n:] == 0).all()
    assert moves == pytest.approx(expected_moves)


def labelled(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = prose(rng.randrange(20, 150), seed * 1000 + i, 400).split()
        toxic = i % 3 == 0
        for _ in range(rng.randrange(2, 5) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["Idiot,", "moron", "zorg" + rng.choice("abcdefghij") + rng.choice("klmnop")]))
        out.append((i, " ".join(words), int(toxic)))
    return out


def scores(model, texts):
    raw, off = common.flat(pa.array(texts, pa.large_string()))
    return toxicity._score_slice(model, raw, off)


def test_held_out_documents_and_spans():
    train, test = labelled(300, 1), labelled(150, 2)
    model = toxicity.fit([t for _, t, _ in train], [y for *_, y in train])
    got = scores(model, [t for _, t, _ in test])
    predicted = [int(s >= 0.7) for s in got["score"].to_pylist()]
    assert sum(p == y for p, (*_, y) in zip(predicted, test)) >= 147
    for (_, text, toxic), spans in zip(test, got["spans"].to_pylist()):
        for s in spans:
            assert any(w in text.encode()[s["start"] : s["end"]].decode().lower() for w in ("idiot", "moron", "zorg"))
        if toxic:
            assert spans


def test_place_and_language_do_not_matter_and_texts_are_read_whole():
    train = labelled(300, 1)
    model = toxicity.fit([t for _, t, _ in train], [y for *_, y in train])
    clean = prose(40_000, 77, 400)
    end = scores(model, [clean, clean + " idiot moron zorgak idiot", "idiot moron zorgak idiot " + clean])["score"].to_pylist()
    assert end[0] < 0.7 <= min(end[1:])


def test_one_label_or_none():
    assert scores(toxicity.fit([], []), ["a", ""])["score"].to_pylist() == [0.0, 0.0]
    assert scores(toxicity.fit(["a b", "c"], [0, 0]), ["a"])["score"].to_pylist() == [0.0]


def test_awkward_rows(spark):
    train = labelled(120, 1)
    model = toxicity.fit([t for _, t, _ in train], [y for *_, y in train])
    docs = awkward(spark, CLASHES)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == 16 and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if not (r["text"] or "").strip()}) == 1
    assert all(r["leaks"] == "own" for r in rows)
    assert toxicity.score(empty(spark), model).collect() == []


def test_sample_skips_nulls_and_counts_repeats_once(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (2, None), (None, "c"), (3, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    texts, known = toxicity.training_sample(docs, labels)
    assert sorted(zip(known, texts))[0] == (0, "") and known == [1, 0] and texts[0] in "ab"


def test_query_keeps_held_out_labels_unseen(spark):
    import zlib

    rows = queries.op6_toxicity(spark, SF).collect()
    assert len(rows) == 200
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)


def test_held_out_quality_on_a_real_table(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op6_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in got}
    # some labelled documents lost their toxic words to other damage
    assert n[1, 1] >= 0.85 * (n[1, 1] + n.get((1, 0), 0))
    assert n.get((0, 1), 0) <= 0.01 * n[0, 0]
