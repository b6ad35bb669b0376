"""Dictionary coding: dense ordered ids, round trip, insert-or-ignore."""

import pytest

from trapline.operators import dedup, dictionary


def test_dense_ids_in_value_order_over_many_partitions(spark):
    vals = spark.createDataFrame([(f"v{i:04d}",) for i in range(500)], "value string")
    d = dictionary.assign_dense_ids(vals, num_partitions=7)
    got = sorted((r["id"], r["value"]) for r in d.collect())
    assert got == [(i + 1, f"v{i:04d}") for i in range(500)]


def test_extend_twice_changes_nothing(spark):
    base = dictionary.build_dictionary(spark.createDataFrame([("b",), ("d",)], "v string"), "v")
    more = spark.createDataFrame([("a",), ("d",), ("e",)], "v string")
    once = dictionary.extend_dictionary(base, more, "v")
    twice = dictionary.extend_dictionary(once, more, "v")
    assert sorted(map(tuple, once.collect())) == [(1, "b"), (2, "d"), (3, "a"), (4, "e")]
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.collect()))


def test_round_trip(spark):
    a = spark.createDataFrame(
        [(1, 10, "s1", "d1", "u1", "p1", "t", "e1"), (2, 20, "s2", "d1", "u1", "p2", "t", "e2")],
        "id long, timestamp long, source_ip string, destination_ip string, username string, password string, "
        "attack_type string, evidence string")
    dicts = dictionary.build_dictionaries(a)
    coded = dictionary.encode(a, dicts)
    assert dict(coded.dtypes)["username"] == "bigint"
    back = dictionary.decode(coded, dicts)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, a.collect()))


def test_dangling_id_drops_out(spark):
    d = spark.createDataFrame([(1, "a")], "id long, value string")
    fact = spark.createDataFrame([(1, 1), (2, 2)], "id long, username long")
    out = dictionary.decode(fact, {"username": d}, columns=["username"]).collect()
    assert [(r["id"], r["username"]) for r in out] == [(1, "a")]


def test_encode_missing_value_fails(spark):
    d = spark.createDataFrame([(1, "a")], "id long, value string")
    df = spark.createDataFrame([(1, "zz")], "id long, username string")
    with pytest.raises(Exception):
        dictionary.encode(df, {"username": d}, columns=["username"]).collect()


def test_dedup_groups_nulls_and_keeps_lowest_id(spark):
    df = spark.createDataFrame([(3, None, "x"), (1, None, "x"), (2, "a", "x")], "id long, k string, v string")
    out = sorted(map(tuple, dedup.dedup_keep_first(df, ["k", "v"], "id").collect()), key=str)
    assert out == sorted([(1, None, "x"), (2, "a", "x")], key=str)


def test_drop_seen(spark):
    new = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    stored = spark.createDataFrame([(1, "a")], "k long, v string")
    assert [tuple(r) for r in dedup.drop_seen(new, stored, ["k", "v"]).collect()] == [(2, "b")]

def _exchanges_of(plan: str) -> int:
    return sum("Exchange hashpartitioning" in line for line in plan.splitlines())


def test_collapsed_encode_shuffles_the_rows_twice_at_most(spark, tmp_path):
    """With broadcasts off: once to their distinct tuples, once to their ids; the payload column takes part in one."""
    rows = [(i, f"s{i % 5}", f"u{i % 3}", "x" * 20) for i in range(300)]
    spark.createDataFrame(rows, "id long, source_ip string, username string, payload string").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    stacked = dictionary.build_dictionaries(df, ["source_ip", "username"], stacked=True)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        coded = dictionary.encode_collapsed(df, stacked, ["source_ip", "username"])
        plan = coded._jdf.queryExecution().sparkPlan().toString()
        physical = coded._jdf.queryExecution().executedPlan().toString()
        got = sorted(map(tuple, coded.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got == [(i, i % 5 + 1, i % 3 + 1, "x" * 20) for i in range(300)]
    assert plan.count("SortMergeJoin") + plan.count("ShuffledHashJoin") == 2  # values to ids, ids to rows
    assert plan.count("FileScan parquet") == 2
    # the rows' own two, and the tuples': values, their ids, the dictionaries
    assert _exchanges_of(physical) <= 5


def test_collapsed_encode_keeps_tuples_apart(spark):
    """Values that read alike when joined, a hot tuple, and rows of no column."""
    schema = "id long, source_ip string, username string"
    rows = [(1, "a", "bc"), (2, "ab", "c"), (3, "1:a", ""), (4, "", "1:a"), *[(n, "a", "bc") for n in range(5, 2000)]]
    df = spark.createDataFrame(rows, schema).repartition(6)
    dicts = dictionary.build_dictionaries(df, ["source_ip", "username"])
    back = dictionary.decode(dictionary.encode_collapsed(df, dictionary.stack_dictionaries(dicts), ["source_ip", "username"]), dicts, ["source_ip", "username"])
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    assert dictionary.encode_collapsed(df.limit(0), dictionary.stack_dictionaries(dicts), ["source_ip", "username"]).collect() == []


@pytest.mark.parametrize("row", [(1, None, "b"), (1, None, None), (1, "zz", "b")])
def test_encode_fails_on_null_and_unknown_values(spark, row):
    dicts = {c: spark.createDataFrame([(1, "a"), (2, "b")], "id long, value string") for c in ("source_ip", "username")}
    df = spark.createDataFrame([(0, "a", "b"), row], "id long, source_ip string, username string")
    with pytest.raises(Exception, match="value missing from dictionary source_ip"):
        dictionary.encode(df, dicts, ["source_ip", "username"]).collect()
    with pytest.raises(Exception, match="value missing from dictionary source_ip"):
        dictionary.encode_collapsed(df, dictionary.stack_dictionaries(dicts), ["source_ip", "username"]).collect()
