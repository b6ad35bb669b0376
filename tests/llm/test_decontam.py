import random

import numpy as np
import pytest
from llm_cases import CLASHES, SF, awkward, empty, prose

from trapline.llm import decontam, queries


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


@pytest.mark.parametrize("seed", range(30))
def test_common_subsequence(seed):
    rng = random.Random(seed)
    a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 90))] for _ in range(2))
    item = decontam.Item(1, a, [])
    assert decontam.common_subsequence(item.masks, len(a), b) == slow_lcs(a, b)


def test_svd_against_numpy(spark):
    rng = np.random.default_rng(1)
    dense = np.zeros((40, 600))
    rows = []
    for i in range(40):
        c = np.sort(rng.choice(600, 12, replace=False))
        w = rng.random(12) * (2.0 if i < 10 else 0.3)
        dense[i, c] = w
        rows.append((c.tolist(), w.tolist()))
    table = spark.createDataFrame(rows, "columns array<long>, weights array<double>").repartition(3)
    got = decontam.randomised_svd(table, 600, rank=40)
    exact = np.linalg.svd(dense, full_matrices=False)
    assert got.shape == (600, 40)
    assert np.linalg.norm(dense - dense @ got @ got.T) < 1e-6 * np.linalg.norm(dense)
    low = decontam.randomised_svd(table, 600, rank=5, power=6)
    assert abs(np.linalg.norm(dense @ low) - np.linalg.norm(exact[1][:5])) < 1e-3 * np.linalg.norm(exact[1][:5])


ITEM = "Which river flows through the old town of Anselm. It was bridged in early times by two masons named Orrin and Tessa. The answer is the silver Maude river"


def table(spark):
    rng = random.Random(9)
    items = [(1, ITEM), (2, prose(50, 100, 3000)), (3, None), (4, "too short"), (5, prose(200, 101, 3000)), (None, prose(40, 102, 3000))]
    filler = lambda n, s: prose(n, s, 3000)
    w = ITEM.split()
    changed = " ".join(x if i % 7 else "other" for i, x in enumerate(w))  # six words of seven stay
    loose = " ".join(x if i % 3 or i > 22 else "other" for i, x in enumerate(w))  # fewer, but the answer whole
    lost = " ".join(x if i % 3 else "other" for i, x in enumerate(w))  # as few, and the answer not whole
    docs = [
        (1, filler(300, 1) + " " + ITEM.lower() + " " + filler(300, 2)), (2, filler(200, 3) + "\n" + changed + "\n" + filler(20, 4)), (3, filler(400, 5)),
        (4, filler(100, 6) + " " + loose + " " + filler(100, 7)), (5, filler(100, 8) + " " + lost + " " + filler(100, 9)), (6, items[4][1]),
        (7, items[1][1] + " " + ITEM), (8, " ".join(rng.sample(w, len(w))) + " " + filler(50, 10)), (9, None), (10, "too short"), (11, filler(90, 11) + " " + items[5][1]), (None, ITEM),
    ]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


FOUND = {(1, 1), (2, 1), (4, 1), (6, 5), (7, 1), (7, 2), (11, None), (None, 1)}


@pytest.mark.parametrize("most", [4096, 2])  # in one part, and in several
def test_copies_paraphrases_and_clean_documents(spark, monkeypatch, most):
    from trapline.llm.shipping import prepare

    prepare(spark)
    monkeypatch.setattr(decontam, "MAX_PASSAGES", most)
    docs, benchmark = table(spark)
    rows = decontam.find_leaks(docs, benchmark).collect()
    assert len(rows) == 12
    assert {(r["doc_id"], x["item_id"]) for r in rows for x in r["leaks"]} == FOUND


def test_awkward_rows_and_empty_tables(spark):
    docs, benchmark = awkward(spark, CLASHES), table(spark)[1]
    rows = decontam.find_leaks(docs, benchmark).collect()
    assert len(rows) == 16 and all(r["leaks"] == [] and r["score"] == "own" for r in rows)
    assert decontam.find_leaks(empty(spark), benchmark).collect() == []
    none = decontam.find_leaks(docs, benchmark.limit(0)).collect()
    assert len(none) == 16 and all(r["leaks"] == [] for r in none)


def test_query_finds_every_verbatim_item(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    truth = {(d["doc_id"], i["item_id"]) for d in docs for i in items if d["text"] and i["text"] in d["text"]}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op7_decontamination(spark, SF).collect()}
    words = {i["item_id"]: decontam.item_of(0, i["text"]) for i in items}
    for d, i in got - truth:  # whatever else is found passes a plain check
        text = next(x["text"] for x in docs if x["doc_id"] == d)
        assert slow_lcs(words[i].words, decontam._hashes(text).tolist()) >= decontam.PARAPHRASED * len(words[i].words)
    assert truth and truth <= got


def planted(spark, least, most, count, seed=5):
    """Items of ``least`` to ``most`` words cut from documents, and other documents that hold one whole."""
    from trapline.llm.shipping import prepare

    prepare(spark)
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("length(text) > 1500").orderBy("doc_id").limit(2 * count).collect()
    rng, items, docs = random.Random(seed), [], []
    for k in range(count):
        source, host = rows[k]["text"].split(), rows[count + k]["text"].split()
        n, cut = rng.randint(least, most), rng.randrange(len(host))
        at = rng.randrange(len(source) - n)
        items.append((k, " ".join(source[at : at + n])))
        docs.append((k, " ".join(host[:cut] + source[at : at + n] + host[cut:])))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def missed(docs, benchmark):
    """Items of ``planted`` that are not found, but for those that count as too short."""
    got = {(r["doc_id"], x["item_id"]) for r in decontam.find_leaks(docs, benchmark).collect() for x in r["leaks"]}
    return [k for k, text in benchmark.collect() if len(decontam.item_of(k, text).words) >= decontam.LEAST_WORDS and (k, k) not in got]


def test_recall_does_not_depend_on_the_size_of_the_benchmark(spark):
    assert missed(*planted(spark, 15, 59, 2000)) == []


def test_short_items_beside_rare_benchmark_words(spark):
    assert missed(*planted(spark, 6, 14, 600)) == []
