import pytest
from llm_cases import DOCS, SF, awkward
from test_repeats import brute_words
from test_simhash import slow_classes

import __spark_entry__ as entry
import corpus_pipeline
from tools.oracle_check import compare
from trapline.llm import decontam, queries, toxicity

TENS = [f"op{n}_" for n in range(1, 11)]


def test_registered():
    names = entry.queries()
    for prefix in TENS:
        assert sum(n.startswith(prefix) for n in names) == 1
    assert "pipeline" in names and [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity"
    assert set(queries.oracle_sql()) <= set(queries.queries())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_its_sql(spark, name):
    report = compare(spark, SF, [name])[name]
    assert report.get("ok") is True, report


def test_stages_against_brute_force(spark):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns

    def rows(df):
        return sorted((tuple(r) for r in df.collect()), key=repr)

    kept = stages["toxicity"](spark, docs, SF)
    assert kept.columns == columns
    bad = {r["doc_id"] for r in queries.op6_toxicity(spark, SF).collect() if r["predicted"]}
    assert rows(kept) == [r for r in rows(docs) if r[0] not in bad]

    docs = spark.createDataFrame(rows(kept), kept.schema)
    kept = stages["simhash_near_dedup"](spark, docs, SF)
    assert kept.columns == columns
    firsts = {c for _, _, c in slow_classes([(r[0], r[1]) for r in rows(docs)])}
    assert rows(kept) == [r for r in rows(docs) if r[0] in firsts]

    docs = spark.createDataFrame(rows(kept), kept.schema)
    kept = stages["substring_dedup"](spark, docs, SF)
    assert kept.columns == columns
    whole = {r[0]: r[1] for r in rows(docs)}
    cut = {d: (t if gone else whole[d]) for d, _, gone, t in brute_words([(r[0], r[1]) for r in rows(docs)], 13)}
    assert {r["doc_id"]: r["text"] for r in kept.collect()} == cut
    assert all(r["n_chars"] == len(r["text"]) for r in kept.collect())

    docs = spark.createDataFrame(rows(kept), kept.schema)
    kept = stages["benchmark_decontamination"](spark, docs, SF)
    assert kept.columns == columns
    items = [decontam.item_of(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items = [i for i in items if len(i.words) >= decontam.LEAST_WORDS]
    leaked = {r[0] for r in rows(docs) if any(i.leaked(decontam._hashes(r[1] or "").tolist()) is not None for i in items)}
    assert rows(kept) == [r for r in rows(docs) if r[0] not in leaked]

    tokens = stages["sentencepiece"](spark, kept, SF)
    want = {r["doc_id"]: tuple(r) for r in queries.token_digests(kept, queries.piece_model()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    assert {r["doc_id"]: (r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in tokens.collect()} == want
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()) == sorted(want)


def test_stages_on_awkward_rows(spark):
    for name, stage in corpus_pipeline.STAGES:
        docs = awkward(spark, ["score", "spans", "leaks", "row_key", "kept_text", "blocks", "ids"])
        out = stage(spark, docs, SF).collect()
        assert out, name
        if name != "sentencepiece":
            assert all(r["score"] == r["ids"] == r["row_key"] == "own" for r in out), name
        if name in ("toxicity", "substring_dedup", "benchmark_decontamination"):
            assert len(out) == 16, name
        assert stage(spark, spark.createDataFrame([], DOCS), SF).collect() == [], name


def test_toxic_bound_is_the_query_s():
    assert corpus_pipeline.TOXIC == queries.TOXIC and toxicity.MAX_TOXIC > 0
