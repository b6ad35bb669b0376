"""Views over the coded store equal the views over decoded attacks."""

import pytest

from conftest import SF_SMALL
from trapline.operators import dictionary
from trapline.plans import catalog, coded_views, views
from trapline.sources import derived


@pytest.fixture(scope="module")
def coded(spark):
    attacks = derived.attack_records(spark, SF_SMALL).checkpoint(eager=True)
    dicts = dictionary.build_dictionaries(attacks)
    fact = dictionary.encode(attacks, dicts).checkpoint(eager=True)
    return attacks, fact, dicts


@pytest.mark.parametrize("name", list(views.VIEWS))
def test_coded_view_equals_plain_view(coded, name):
    attacks, fact, dicts = coded
    for tz in ["UTC", "Europe/Berlin"]:
        plain = views.build_view(name, attacks, as_of=catalog.AS_OF, tz=tz)
        fast = coded_views.coded_view(name, fact, dicts, as_of=catalog.AS_OF, tz=tz)
        assert fast.columns == plain.columns
        assert [tuple(r) for r in fast.collect()] == [tuple(r) for r in plain.collect()]  # order too


def test_every_view_is_also_registered_over_the_stored_table_and_sql():
    assert {f"{kind}_{name}" for kind in ("coded", "stored", "sql") for name in views.VIEWS} <= set(catalog.queries())


def test_logins_whose_values_hold_the_separator(spark):
    from trapline.operators import dictionary
    from trapline.plans import coded_views, views

    sep = " <-| username @ password |-> "
    pairs = [("a", "b" + sep + "c"), ("a" + sep + "b", "c"), ("a", "b"), ("a", "c"), ("x" + sep, "y"), ("x", sep + "y")]
    rows = [(i, 1000 * i, f"s{i % 2 if i < 12 else 7}", "d", *pairs[i % len(pairs)], "t", "e") for i in range(20)]
    attacks = spark.createDataFrame(rows, "id long, timestamp long, source_ip string, destination_ip string, username string, password string, attack_type string, evidence string")
    want = {}
    for _, _, source, _, user, word, _, _ in rows:
        of = want.setdefault(source, (set(), set(), set()))
        for found, value in zip(of, (user, word, user + sep + word)):
            found.add(value)
    dicts = dictionary.build_dictionaries(attacks)
    fact = dictionary.encode(attacks, dicts)
    for view in (views.view_attack_patterns_by_source(attacks, tz="UTC"), coded_views.coded_view("view_attack_patterns_by_source", fact, dicts, tz="UTC")):
        got = view.collect()
        assert {r["source_ip"]: (r["unique_usernames"], r["unique_passwords"], r["unique_logins"]) for r in got} == {s: tuple(map(len, of)) for s, of in want.items()}
        assert sum(r["total_attacks"] for r in got) == 20


def test_one_scan_for_all_counts_of_a_source(spark, tmp_path):
    from trapline.plans import views

    spark.createDataFrame([(1, 5, "s", "u", "p")], "id long, timestamp long, source_ip string, username string, password string").write.parquet(f"{tmp_path}/a")
    view = views.view_attack_patterns_by_source(spark.read.parquet(f"{tmp_path}/a"), tz="UTC")
    view.collect()
    assert view._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
