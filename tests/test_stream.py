"""Streaming ingest: stream result equals batch dedup; restarts add nothing."""


from pyspark.sql import functions as F

from conftest import SF_SMALL
from trapline.schema import KEY7
from trapline.session import scratch_path
from trapline.sources import derived, store, submissions
from trapline.streaming import ingest


def _stage(spark, files=3):
    path = scratch_path(spark, "test-requests")
    derived.request_log(spark, SF_SMALL).repartition(files).write.parquet(path)
    return path


def _run(spark, src, root, ckpt, coded=False):
    schema = spark.read.parquet(src).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = ingest.start_ingest(stream, root, checkpoint=ckpt, tz="UTC", coded=coded)
    q.awaitTermination()
    assert q.exception() is None


def _expected(spark):
    records, _ = submissions.ingest_requests(derived.request_log(spark, SF_SMALL), tz="UTC")
    return sorted(map(tuple, records.select(*KEY7).distinct().collect()))


def test_stream_equals_batch_and_restart_is_idempotent(spark):
    src = _stage(spark)
    root = scratch_path(spark, "test-store")
    _run(spark, src, root, root + "-ck1")
    got = sorted(map(tuple, store.read_attacks(spark, root).select(*KEY7).collect()))
    assert got == _expected(spark)
    n = store.read_attacks(spark, root).count()
    # same checkpoint: nothing new to read; fresh checkpoint: replays all input
    _run(spark, src, root, root + "-ck1")
    _run(spark, src, root, root + "-ck2")
    again = store.read_attacks(spark, root)
    assert again.count() == n
    assert again.select("id").distinct().count() == n
    rejected = spark.read.parquet(root + "/rejected")
    assert rejected.select("event_id").distinct().count() > 0


def test_coded_stream_round_trips(spark):
    from trapline.operators import dictionary

    src = _stage(spark)
    root = scratch_path(spark, "test-coded")
    _run(spark, src, root, root + "-ck", coded=True)
    fact, dicts = store.read_coded(spark, root)
    for c, d in dicts.items():
        assert d.count() == d.select("value").distinct().count() == d.select("id").distinct().count()
    got = sorted(map(tuple, dictionary.decode(fact.drop("date"), dicts).select(*KEY7).collect()))
    assert got == _expected(spark)


def test_log_lines_of_stored_rows(spark):
    src = _stage(spark, files=2)
    for coded in (False, True):
        root = scratch_path(spark, "test-log")
        schema = spark.read.parquet(src).schema
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        q = ingest.start_ingest(stream, root, checkpoint=root + "-ck", tz="UTC", coded=coded, log_lines=True)
        q.awaitTermination()
        assert q.exception() is None
        lines = spark.read.text(root + "/log").collect()
        assert len(lines) == len(_expected(spark))
        assert all(" | From: " in r["value"] and " | Pass: " in r["value"] for r in lines)


def test_batch_over_many_days_is_idempotent(spark):
    # 100 distinct days: the history filter falls back to the day list
    bodies = []
    for i in range(200):
        day = 1 + i % 100
        ts = f"2023-{1 + (day - 1) // 28:02d}-{1 + (day - 1) % 28:02d}T10:00:{i % 60:02d}Z"
        bodies.append((i, '{"source_ip":"10.0.0.%d","username":"u","password":"p","attack_timestamp":"%s"}' % (i % 3, ts)))
    batch = spark.createDataFrame(bodies, "n long, body string")
    root = scratch_path(spark, "test-days")
    ingest.process_batch(batch, 0, root, tz="UTC")
    first = store.read_attacks(spark, root).count()
    ingest.process_batch(batch, 1, root, tz="UTC")
    again = store.read_attacks(spark, root)
    assert first == again.count() == batch.count()
    assert again.select("date").distinct().count() == 100


def _bodies(spark, n, start=0, time="2023-05-01T10:00:00Z", more=()):
    rows = [(i, '{"source_ip":"10.0.%d.%d","username":"u","password":"p%d","attack_timestamp":"%s"}' % (i // 256, i % 256, i, time)) for i in range(start, start + n)]
    return spark.createDataFrame([*rows, *more], "n long, body string")


def test_new_checkpoints_keep_ids_rejected_and_log_lines(spark):
    root = scratch_path(spark, "test-runs")
    ingest.process_batch(_bodies(spark, 50, more=[(900, "bad one")]), 0, root, tz="UTC", log_lines=True, run="a")
    ingest.process_batch(_bodies(spark, 50, start=25, more=[(901, "bad two")]), 0, root, tz="UTC", log_lines=True, run="b")
    ingest.process_batch(_bodies(spark, 50, start=25, more=[(901, "bad two")]), 0, root, tz="UTC", log_lines=True, run="b")  # a rerun
    stored = store.read_attacks(spark, root)
    assert stored.count() == stored.select("id").distinct().count() == 75
    assert sorted(r["body"] for r in spark.read.parquet(f"{root}/rejected").collect()) == ["bad one", "bad two"]
    assert spark.read.text(f"{root}/log").count() == 75


def test_ids_go_on_above_rows_written_by_a_batch_job(spark):
    root = scratch_path(spark, "test-ids")
    ingest.process_batch(_bodies(spark, 3), 0, root, tz="UTC")
    top = store.read_attacks(spark, root).agg({"id": "max"}).first()[0]
    more = store.read_attacks(spark, root).drop("date").selectExpr("id + 1000 AS id", "timestamp + 1 AS timestamp", *KEY7[1:])
    store.write_attacks(more.checkpoint(), root, "append")
    ingest.process_batch(_bodies(spark, 4, start=100), 1, root, tz="UTC")
    ids = [r["id"] for r in store.read_attacks(spark, root).select("id").collect()]
    assert len(set(ids)) == 10 and max(ids) == top + 1000 + 4


def test_rows_without_a_time_late_and_far_future_ones(spark):
    root = scratch_path(spark, "test-zero")
    zero = [(10_000 + i, '{"source_ip":"10.9.%d.%d","username":"u","password":"p"}' % (i // 256, i % 256)) for i in range(300)]
    late = [(20_000, '{"source_ip":"1.1.1.1","username":"u","password":"p","attack_timestamp":"1971-01-01T00:00:00Z"}')]
    future = [(20_001, '{"source_ip":"1.1.1.1","username":"u","password":"p","attack_timestamp":"9999-12-31T23:59:59-23:30"}')]
    for k in range(2):  # the second time all is known
        ingest.process_batch(_bodies(spark, 300, more=[*zero, *late, *future]), k, root, tz="UTC")
    stored = store.read_attacks(spark, root)
    assert stored.count() == 602
    assert stored.filter("timestamp = -62135596800000").count() == 300
    assert stored.filter("date IS NULL").count() == 1  # a time past year 9999 has no date


def test_history_reads_only_the_batch_s_days(spark):
    root = scratch_path(spark, "test-prune")
    for day in (1, 2, 3):
        ingest.process_batch(_bodies(spark, 5, time=f"2023-05-0{day}T10:00:00Z"), day, root, tz="UTC")
    rows = store.read_attacks(spark, root).filter("date = '2023-05-02'").drop("date").checkpoint()
    seen = ingest._history(store.read_attacks(spark, root), rows)
    assert seen.count() == 5
    assert "dynamicpruning" in seen._jdf.queryExecution().executedPlan().toString()


def test_one_instant_is_written_by_several_tasks(spark):
    rows = spark.range(200_000).selectExpr("id", "-62135596800000L AS timestamp", "concat('10.', id % 250, '.', id) AS source_ip",
                                           "'d' AS destination_ip", "'u' AS username", "concat('p', id) AS password", "'t' AS attack_type", "'e' AS evidence")
    root = scratch_path(spark, "test-hot")
    store.write_attacks(rows, root, "overwrite")
    files = store.read_attacks(spark, root).selectExpr("input_file_name() AS f").distinct().count()
    assert files > 1


def test_absurd_stored_time_has_no_text_but_counts(spark):
    from trapline.plans import views

    root = scratch_path(spark, "test-absurd")
    rows = spark.createDataFrame([(1, 9 * 10**18, *"abcdef"), (2, 253402300800000, *"abcdef"), (3, 1704164645000, *"abcdef")], "id long, timestamp long, source_ip string, destination_ip string, username string, password string, attack_type string, evidence string")
    store.write_attacks(rows, root, "overwrite")
    back = store.read_attacks(spark, root)
    for tz in ("UTC", "Europe/Berlin"):
        for name in views.VIEWS:
            views.build_view(name, back, as_of="2024-01-03T00:00:00Z", tz=tz).collect()
    assert {r["time"] for r in views.view_log(back, tz="UTC").collect()} == {None, "2024-01-02 03:04:05"}
    assert views.report_top_attackers_last_24_hours(back, as_of="2024-01-03T00:00:00Z").first()["count"] == 3


def test_a_broken_table_is_no_empty_history(spark):
    import pytest

    root = scratch_path(spark, "test-broken")
    assert store.table_exists(spark, root, "attacks") is False
    spark.range(3).selectExpr("CAST(id AS STRING)").write.text(f"{root}/attacks")
    with pytest.raises(Exception):
        ingest.process_batch(_bodies(spark, 3), 0, root, tz="UTC")


def test_restart_queries_see_a_wrong_row_and_a_wrong_line(spark, monkeypatch):
    from tools.oracle_check import compare
    from trapline.plans import catalog

    names = ["stream_ingest_restart", "stream_ingest_restart_rows", "stream_ingest_restart_log", "stream_ingest_restart_rejected"]
    run = catalog._run_restart

    def broken(spark, sf_dir):
        root = run(spark, sf_dir)
        rows = store.read_attacks(spark, root).drop("date").checkpoint()
        store.write_attacks(rows.withColumn("password", rows.username), root, "overwrite")
        lines = spark.read.text(f"{root}/log").drop("run", "batch_id").selectExpr("concat(value, '!') AS value").checkpoint()
        lines.write.mode("overwrite").text(f"{root}/log")
        bad = spark.read.parquet(f"{root}/rejected").drop("run", "batch_id").withColumn("body", F.lit("other")).checkpoint()
        bad.write.mode("overwrite").parquet(f"{root}/rejected")
        return root

    monkeypatch.setattr(catalog, "_run_restart", broken)
    found = compare(spark, SF_SMALL, names)
    assert [found[n]["ok"] for n in names] == [True, False, False, False], found  # the counts alone see nothing


def test_a_log_cut_off_while_written_is_written_again(spark):
    root = scratch_path(spark, "test-cut-log")
    cut = spark.range(2).selectExpr("'part of the log' AS value").coalesce(1).write
    cut.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").text(f"{root}/log/run=a/batch_id=0")
    ingest.process_batch(_bodies(spark, 20), 0, root, tz="UTC", log_lines=True, run="a")
    lines = [r["value"] for r in spark.read.text(f"{root}/log").collect()]
    assert len(lines) == 20 and all(" | From: " in x for x in lines)


def test_a_whole_log_stays_when_its_rows_were_stored_in_part(spark):
    root = scratch_path(spark, "test-part-rows")
    ingest.process_batch(_bodies(spark, 20), 0, root, tz="UTC", log_lines=True, run="a")
    half = store.read_attacks(spark, root).drop("date").filter("id % 2 = 0").checkpoint()
    store.write_attacks(half, root, "overwrite")
    ingest.process_batch(_bodies(spark, 20), 0, root, tz="UTC", log_lines=True, run="a")  # the rerun
    assert store.read_attacks(spark, root).count() == spark.read.text(f"{root}/log").count() == 20


def test_history_reads_only_the_buckets_of_rows_without_a_time(spark):
    root = scratch_path(spark, "test-buckets")
    zero = [(i, '{"source_ip":"10.9.%d.%d","username":"u","password":"p"}' % (i // 256, i % 256)) for i in range(400)]
    ingest.process_batch(spark.createDataFrame(zero, "n long, body string"), 0, root, tz="UTC")
    stored = store.read_attacks(spark, root, buckets=True)
    assert stored.select("bucket").distinct().count() > store.BUCKETS // 2
    few = store.read_attacks(spark, root).filter("source_ip IN ('10.9.0.1', '10.9.0.2')").drop("date").checkpoint()
    seen = ingest._history(stored, few)
    read = {r["f"] for r in seen.selectExpr("input_file_name() AS f").distinct().collect()}
    wanted = {r["bucket"] for r in store.with_place(few).select("bucket").collect()}
    assert 1 <= len(read) <= len(wanted) <= 2
    assert all(any(f"bucket={b}/" in f for b in wanted) for f in read)
    plan = seen._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan[plan.index("PartitionFilters: ["):]
    ingest.process_batch(spark.createDataFrame(zero, "n long, body string"), 1, root, tz="UTC")
    assert store.read_attacks(spark, root).count() == 400


def test_checkpoint_folder_does_not_grow_with_batches(spark):
    import os

    def size(path):
        path = path.removeprefix("file:")
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files)

    from trapline.session import checkpoint_root

    spark.range(1).checkpoint()  # the folder is there
    root = scratch_path(spark, "test-growth")
    before = size(checkpoint_root(spark)) - size(root)
    for k in range(10):
        ingest.process_batch(_bodies(spark, 40, start=40 * k), k, root, tz="UTC")
    assert store.read_attacks(spark, root).count() == 400
    assert size(checkpoint_root(spark)) - size(root) == before


def test_ids_follow_arrival(spark):
    root = scratch_path(spark, "test-order")
    batch = _bodies(spark, 200, more=[(900, "bad")]).repartition(3).sortWithinPartitions("n")
    arrived = [r["p"] for r in batch.selectExpr("get_json_object(body, '$.password') AS p").collect() if r["p"]]
    ingest.process_batch(batch, 0, root, tz="UTC")
    stored = store.read_attacks(spark, root).orderBy("id").collect()
    assert [r["password"] for r in stored] == arrived


def _run_bounded(spark, src, root, horizon):
    schema = "body string, arrived timestamp"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    for q in ingest.start_bounded_ingest(stream, root, horizon=horizon, arrival="arrived", checkpoint=root + "-ck", tz="UTC"):
        q.awaitTermination()
        assert q.exception() is None


def test_bounded_state_keeps_repeats_out_up_to_its_horizon(spark):
    body = '{"source_ip":"10.0.0.1","username":"%s","password":"p","attack_timestamp":"%s"}'
    src, root = scratch_path(spark, "test-arrivals"), scratch_path(spark, "test-bounded")
    batches = [
        ("2024-01-01 00:00:00", [body % ("a", "2024-01-01T00:00:00Z"), body % ("old", "1971-01-01T00:00:00Z"), "bad"]),
        ("2024-01-01 00:30:00", [body % ("a", "2024-01-01T00:00:00Z"), body % ("b", "2024-01-01T00:00:00Z"), body % ("far", "9999-01-01T00:00:00Z")]),
        ("2024-01-01 05:00:00", [body % ("c", "2024-01-01T00:00:00Z")]),
        ("2024-01-01 06:00:00", [body % ("a", "2024-01-01T00:00:00Z"), body % ("c", "2024-01-01T00:00:00Z")]),
    ]
    for at, bodies in batches:  # a file a batch, in order of arrival
        rows = spark.createDataFrame([(b, at) for b in bodies], "body string, at string").selectExpr("body", "CAST(at AS TIMESTAMP) AS arrived")
        rows.coalesce(1).write.mode("append").parquet(src)
        _run_bounded(spark, src, root, "1 hour")  # a restart for each
    stored = store.read_attacks(spark, root)
    names = sorted(r["username"] for r in stored.collect())
    # a's repeat within the hour is dropped, that after six hours is stored; late and far future times are accepted
    assert names == ["a", "a", "b", "c", "far", "old"]
    assert stored.select("id").distinct().count() == 6
    assert [r["body"] for r in spark.read.parquet(f"{root}/rejected_stream").collect()] == ["bad"]


def test_a_bounded_batch_that_was_cut_off_stores_nothing_twice(spark):
    root = scratch_path(spark, "test-bounded-cut")
    rows = spark.createDataFrame([(1704067200000 + i, "s", "d", "u", f"p{i}", "t", "e") for i in range(50)], "timestamp long, source_ip string, destination_ip string, username string, password string, attack_type string, evidence string").select(*KEY7)
    ingest._append_batch(rows, 0, root, "a")
    ingest._append_batch(rows, 0, root, "a")  # finished: nothing to do
    assert store.read_attacks(spark, root).count() == 50
    half = store.read_attacks(spark, root).drop("date").filter("id % 2 = 0").checkpoint()
    store.write_attacks(half, root, "overwrite")
    spark.range(0).selectExpr("CAST(id AS STRING) AS value").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").mode("overwrite").text(f"{root}/bounded/run=a/batch_id=0/done")
    ingest._append_batch(rows, 0, root, "a")  # begun, rows stored in part, not finished
    stored = store.read_attacks(spark, root)
    assert stored.count() == 50 == stored.select("id").distinct().count()


def _sent(spark, first, last):
    """Requests of sources of their own, and of one that all batches share."""
    body = F.to_json(F.struct(
        F.when(F.col("id") % 3 == 0, "root").otherwise(F.concat(F.lit("s"), "id")).alias("source_ip"), F.lit("d").alias("destination_ip"),
        F.concat(F.lit("u"), (F.col("id") % 4).cast("string")).alias("username"), F.lit("p").alias("password"), F.lit("ssh").alias("attack_type"),
        F.concat(F.lit("e"), "id").alias("evidence"), F.lit("2024-03-01T10:00:00Z").alias("attack_timestamp"),
    ))
    return spark.range(first, last, numPartitions=3).select(body.alias("body"))


def test_a_batch_joins_its_own_dictionary_entries_only(spark, monkeypatch):
    from trapline.operators import dictionary

    root = scratch_path(spark, "test-lookup")
    reads, joined = [], []
    read, encode = store.read_stacked_dictionaries, dictionary.encode
    monkeypatch.setattr(store, "read_stacked_dictionaries", lambda *a: reads.append(1) or read(*a))

    def watched(rows, dicts, *more):
        joined.append({c: d.count() for c, d in dicts.items()})
        return encode(rows, dicts, *more)

    monkeypatch.setattr(dictionary, "encode", watched)
    ingest.process_batch(_sent(spark, 0, 300), 0, root, "UTC", coded=True)
    assert len(reads) == 1 and joined[0]["source_ip"] == 201 and joined[0]["username"] == 4
    ingest.process_batch(_sent(spark, 300, 312), 1, root, "UTC", coded=True)
    # 12 rows: 8 sources and "root", 4 names; the 313 and more entries of the store are not joined with
    assert len(reads) == 3 and joined[1] == {"source_ip": 9, "destination_ip": 1, "username": 4, "password": 1, "attack_type": 1, "evidence": 12}
    ingest.process_batch(_sent(spark, 300, 312), 2, root, "UTC", coded=True)  # nothing new
    assert len(reads) == 5
    assert store.read_fact(spark, root).count() == 312
    dicts = store.read_dictionaries(spark, root)
    for c, n in {"source_ip": 209, "username": 4, "evidence": 312}.items():
        ids = sorted(r["id"] for r in dicts[c].collect())
        assert ids == list(range(1, n + 1))


def test_dictionary_marks_survive_lost_entries_and_batch_writes(spark):
    from trapline.operators import dictionary

    root = scratch_path(spark, "test-marks")
    ingest.process_batch(_sent(spark, 0, 30), 0, root, "UTC", coded=True)
    # a batch that was lost between its marks and its entries: its ids are not given again
    assert store.reserve_entries(spark, root, {"evidence": 5}) == {"source_ip": 21, "destination_ip": 1, "username": 4, "password": 1, "attack_type": 1, "evidence": 30}
    ingest.process_batch(_sent(spark, 30, 33), 1, root, "UTC", coded=True)
    dicts = store.read_dictionaries(spark, root)
    assert sorted(r["id"] for r in dicts["evidence"].collect()) == [*range(1, 31), 36, 37, 38]
    # entries with ids of their own come in: the marks are void, the stored ids are looked through
    store.write_dictionaries({"evidence": spark.createDataFrame([(1000, "other")], "id long, value string")}, root)
    ingest.process_batch(_sent(spark, 33, 36), 2, root, "UTC", coded=True)
    dicts = store.read_dictionaries(spark, root)
    assert sorted(r["id"] for r in dicts["evidence"].collect())[-4:] == [1000, 1001, 1002, 1003]
    fact = store.read_fact(spark, root)
    want = sorted(r["body"] for r in _sent(spark, 0, 36).select(F.get_json_object("body", "$.evidence").alias("body")).collect())
    assert sorted(r["evidence"] for r in dictionary.decode(fact.drop("date"), dicts).collect()) == want


def test_a_batch_in_one_split_is_decoded_by_all_tasks(spark, monkeypatch):
    seen, decode = [], ingest.decode_tagged
    monkeypatch.setattr(ingest, "decode_tagged", lambda df, **more: seen.append(df.rdd.getNumPartitions()) or decode(df, **more))
    root = scratch_path(spark, "test-dealt")
    batch = _bodies(spark, 64, more=[(900, "bad")]).coalesce(1)
    ingest.process_batch(batch, 0, root, tz="UTC")
    assert seen == [8]
    # ids still follow the one split's order, and the rejected body is kept
    ids = [r["password"] for r in store.read_attacks(spark, root).orderBy("id").collect()]
    assert ids == [f"p{i}" for i in range(64)]
    assert [r["body"] for r in spark.read.parquet(f"{root}/rejected").collect()] == ["bad"]


def test_a_bounded_ingest_decodes_a_batch_by_all_tasks(spark, monkeypatch):
    seen, decode = [], ingest.decode_tagged
    monkeypatch.setattr(ingest, "decode_tagged", lambda df, **more: seen.append(df._jdf.queryExecution().logical().toString()) or decode(df, **more))
    src, root = scratch_path(spark, "test-bodies"), scratch_path(spark, "test-bounded-dealt")
    _bodies(spark, 20).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("n long, body string").parquet(src)
    for q in ingest.start_bounded_ingest(stream, root, tz="UTC"):
        q.awaitTermination()
        assert q.exception() is None
    assert "Repartition 8, true" in seen[0]
    assert store.read_attacks(spark, root).count() == 20


def test_requests_are_staged_as_a_file_for_every_core_and_batch(spark):
    from trapline.plans import catalog

    sizes, files = [], []
    stream = catalog._staged(spark, spark.range(400).toDF("event_id"), 2)

    def take(df, _):
        sizes.append(df.count())
        files.append(df.select(F.input_file_name()).distinct().count())

    q = stream.writeStream.foreachBatch(take).option("checkpointLocation", scratch_path(spark, "test-staged")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.exception() is None
    assert len(sizes) == 2 and sum(sizes) == 400
    assert files == [spark.sparkContext.defaultParallelism] * 2
