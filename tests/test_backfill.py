"""Backfill of the flat table: no NULLs, no repeats, trimming merges rows."""


from trapline.plans import backfill
from trapline.schema import LEGACY


def test_backfill_trims_before_dedup(spark):
    rows = [
        (5, "s", "d", "u", "p", 1000, "ev \n", "t"),
        (3, "s", "d", "u", "p", 1000, "ev", "t"),      # equal after trim: keeps id 3
        (7, "s", "d", None, "p", 1000, "ev", "t"),     # incomplete: dropped
        (8, "s", "d", None, "p", 1000, "ev", "t"),
    ]
    legacy = spark.createDataFrame(rows, LEGACY)
    fact, dicts, attacks = backfill.backfill(legacy)
    got = attacks.collect()
    assert [(r["id"], r["evidence"]) for r in got] == [(3, "ev")]
    f = fact.collect()
    assert len(f) == 1 and f[0]["id"] == 3 and all(f[0][c] == 1 for c in ["source_ip", "username", "evidence"])


def test_backfill_output_complete_and_unique(spark):
    from conftest import SF_SMALL
    from trapline.sources import derived

    fact, _, _ = backfill.backfill(derived.legacy_records(spark, SF_SMALL))
    cols = [c for c in fact.columns if c != "id"]
    assert fact.filter(" OR ".join(f"{c} IS NULL" for c in fact.columns)).count() == 0
    assert fact.count() == fact.select(*cols).distinct().count()
