"""Submission decoding: strict JSON types, defaults, quarantine, routing."""

from trapline.operators import filters
from trapline.sources import submissions

ZERO = -62135596800000


def _decode(spark, bodies):
    df = spark.createDataFrame(list(enumerate(bodies)), "n int, body string")
    acc, rej = submissions.decode(df, tz="UTC")
    return {r["n"]: r for r in acc.collect()}, {r["n"]: r["reason"] for r in rej.collect()}


def test_accepted_bodies(spark):
    bodies = ['{}', 'null', '{"source_ip":null}', '{"source_ip":"a","source_ip":"b"}',
              '{"source_ip":"a","extra":1}', '  {"username":"x"}  ']
    acc, rej = _decode(spark, bodies)
    assert not rej
    assert acc[0]["source_ip"] == "" and acc[0]["timestamp"] == ZERO and acc[0]["test_mode"] is False
    assert acc[1]["username"] == "" and acc[1]["timestamp"] == ZERO
    assert acc[2]["source_ip"] == ""
    assert acc[3]["source_ip"] == "b"
    assert acc[4]["source_ip"] == "a"
    assert acc[5]["username"] == "x"


def test_rejected_bodies(spark):
    bodies = ['{"source_ip":5}', '{"test_mode":"true"}', '{"source_ip":', '[]', '{"source_ip":"a"} x', '',
              '{"attack_timestamp":1700000000}', '{"attack_timestamp":"yesterday"}', '"str"']
    acc, rej = _decode(spark, bodies)
    assert not acc
    assert rej == {
        0: "wrong_field_type", 1: "wrong_field_type", 2: "not_json_object", 3: "not_json_object",
        4: "not_json_object", 5: "not_json_object", 6: "wrong_field_type", 7: "bad_attack_timestamp",
        8: "not_json_object",
    }


def test_time_null_spellings_give_zero_time(spark):
    acc, _ = _decode(spark, ['{"attack_timestamp":null}', '{"attack_timestamp":"null"}'])
    assert acc[0]["timestamp"] == ZERO and acc[1]["timestamp"] == ZERO


def test_clean_trims_unicode_and_drops_tests(spark):
    ev = "　 \x0b\t x \n\r\u0085"
    df = spark.createDataFrame([(0, '{"evidence":"%s"}' % ev.encode("unicode_escape").decode().replace("\\x", "\\u00")),
                                (1, '{"test_mode":true}')], "n int, body string")
    acc, _ = submissions.decode(df, tz="UTC")
    out = submissions.clean(acc).collect()
    assert [(r["n"], r["evidence"]) for r in out] == [(0, "x")]


def test_routing_keeps_post_add_attack_only(spark):
    df = spark.createDataFrame(
        [("POST", "/add_attack"), ("GET", "/add_attack"), ("POST", "/check_ip")], "method string, path string")
    assert filters.only_submissions(df).count() == 1


def test_keys_match_ignoring_case_last_non_null_wins(spark):
    bodies = ['{"SOURCE_IP":"a"}', '{"Source_Ip":"x","source_ip":"y"}', '{"source_ip":"a","source_ip":null}',
              '{"attack_timestamp":"2024-01-02T03:04:05Z","attack_timestamp":"null"}']
    acc, rej = _decode(spark, bodies)
    assert not rej
    assert [acc[i]["source_ip"] for i in range(3)] == ["a", "y", "a"]
    assert acc[3]["timestamp"] == 1704164645000


def test_any_wrong_occurrence_rejects(spark):
    bodies = ['{"source_ip":5,"source_ip":"b"}', '{"attack_timestamp":"yesterday","attack_timestamp":"2024-01-02T03:04:05Z"}']
    acc, rej = _decode(spark, bodies)
    assert not acc and rej == {0: "wrong_field_type", 1: "bad_attack_timestamp"}


def test_exact_key_mode(spark):
    df = spark.createDataFrame([(0, '{"SOURCE_IP":"a"}')], "n int, body string")
    acc, _ = submissions.decode(df, tz="UTC", key_case="exact")
    assert acc.first()["source_ip"] == ""


def test_fields_and_times_are_read_once_a_row(spark):
    spark.conf.set("spark.sql.debug.maxToStringFields", 10_000)
    try:
        raw = spark.createDataFrame([("POST", "/add_attack", "{}")], "method string, path string, body string")
        records, _ = submissions.ingest_requests(raw, tz="UTC")
        plan = records.select("timestamp", "username", "evidence")._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    # the layout of a time is tested in one place, whatever filters and columns refer to it
    assert plan.count("([.,]") == 1


def test_a_flag_that_is_no_boolean_rejects_its_record_alone(spark):
    tagged = submissions.decode_tagged(spark.createDataFrame([(0, '{"test_mode":"abc"}'), (1, '{"username":"u"}')], "n int, body string"), tz="UTC")
    rows = {r["n"]: (r["reason"], r["username"]) for r in tagged.collect()}
    assert rows == {0: ("wrong_field_type", ""), 1: (None, "u")}


def test_other_keys_beside_exact_ones(spark):
    bodies = ['{"USERNAME":"A","x":1}', '{"username":"a","Username":null}', '{"username":"a","x":1,"x":2}', '{"username":"a","K\u212a":1}']
    acc, rej = _decode(spark, bodies)
    assert not rej and [acc[n]["username"] for n in range(4)] == ["A", "a", "a", "a"]
