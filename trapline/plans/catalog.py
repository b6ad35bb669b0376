"""Registered queries and their DuckDB oracle SQL.

``queries()`` maps a name to ``fn(spark, sf_dir) -> DataFrame``; each reads
the driver's tables under ``sf_dir`` (the ``events`` table) and runs one
operator or view of this engine over all of it. ``oracle_sql()`` gives, for
the same name, independent SQL over the same tables with the same column
names. Reports use a fixed "now" (``AS_OF``) and zone (``TZ``) so both sides
agree.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from ..functions import text as textfn
from ..operators import dedup, dictionary, filters
from ..schema import KEY7, TEXT_COLUMNS
from ..session import scratch_path
from ..sources import derived, store, submissions
from ..streaming import ingest
from . import backfill as backfill_plan
from . import coded_views, rollup, views

# fixed evaluation point of all reports: the end of the events month
AS_OF = "2024-01-31T00:00:00+00:00"
TZ = "UTC"

_AS_OF_DT = _dt.datetime.fromisoformat(AS_OF)


def _view_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return views.build_view(name, derived.attack_records(spark, sf_dir), as_of=AS_OF, tz=TZ)

    run.__name__ = name
    return run


# history cut used to split "stored" from "incoming" rows
HISTORY_END = "2024-01-21T00:00:00+00:00"
# an early cut, so extending a dictionary adds many values
EARLY_END = "2024-01-03T00:00:00+00:00"


def _ms(iso: str) -> int:
    return int(_dt.datetime.fromisoformat(iso).timestamp()) * 1000


def _submitted_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routed, decoded, cleaned submissions (with their event_id)."""
    records, _ = submissions.ingest_requests(derived.request_log(spark, sf_dir), tz=TZ)
    return records


def q_decode_submissions(spark, sf_dir):
    return _submitted_records(spark, sf_dir).select("event_id", *KEY7)


def q_rejected_submissions(spark, sf_dir):
    _, rejected = submissions.ingest_requests(derived.request_log(spark, sf_dir), tz=TZ)
    return rejected.select("event_id", "reason")


def q_dedup_submissions(spark, sf_dir):
    rec = _submitted_records(spark, sf_dir).select((F.col("event_id") + 1).alias("id"), *KEY7)
    return dedup.dedup_keep_first(rec, KEY7, "id")


def q_drop_seen_attacks(spark, sf_dir):
    stored = derived.attack_records(spark, sf_dir).filter(F.col("timestamp") < F.lit(_ms(HISTORY_END)))
    incoming = _submitted_records(spark, sf_dir).select("event_id", *KEY7)
    return dedup.drop_seen(incoming, stored, KEY7)


def q_drop_incomplete_legacy(spark, sf_dir):
    return filters.drop_incomplete(derived.legacy_records(spark, sf_dir), TEXT_COLUMNS, time_col="attack_timestamp")


def q_trim_evidence(spark, sf_dir):
    legacy = derived.legacy_records(spark, sf_dir)
    return legacy.select("id", textfn.trim_blanks("evidence").alias("evidence"))


def _dictionary_query(column: str):
    def run(spark, sf_dir):
        return dictionary.build_dictionary(derived.attack_records(spark, sf_dir), column)

    run.__name__ = f"dictionary_{column}"
    return run


def _extend_query(column: str):
    def run(spark, sf_dir):
        attacks = derived.attack_records(spark, sf_dir)
        early = attacks.filter(F.col("timestamp") < F.lit(_ms(EARLY_END)))
        base = dictionary.build_dictionary(early, column)
        return dictionary.extend_dictionary(base, attacks, column)

    run.__name__ = f"extend_dictionary_{column}"
    return run


def q_encode_attacks(spark, sf_dir):
    attacks = derived.attack_records(spark, sf_dir).checkpoint(eager=True)
    return dictionary.encode(attacks, dictionary.build_dictionaries(attacks))


def q_decode_attacks(spark, sf_dir):
    attacks = derived.attack_records(spark, sf_dir).checkpoint(eager=True)
    dicts = dictionary.build_dictionaries(attacks)
    return dictionary.decode(dictionary.encode(attacks, dicts), dicts)


def q_backfill_attacks(spark, sf_dir):
    fact, _, _ = backfill_plan.backfill(derived.legacy_records(spark, sf_dir))
    return fact


def q_log_lines(spark, sf_dir):
    a = derived.attack_records(spark, sf_dir)
    return a.select("id", textfn.log_line("timestamp", "source_ip", "username", "password", tz=TZ).alias("line"))


def _staged(spark: SparkSession, requests: DataFrame, batches: int) -> DataFrame:
    """A stream of ``requests`` that arrive in ``batches`` batches, each as a file for every core."""
    src, files = scratch_path(spark, "requests"), spark.sparkContext.defaultParallelism
    requests.repartition(batches * files).write.parquet(src)
    return spark.readStream.schema(requests.schema).option("maxFilesPerTrigger", files).parquet(src)


def _run_stream(spark: SparkSession, sf_dir: str, coded: bool) -> str:
    root = scratch_path(spark, "store")
    stream = _staged(spark, derived.request_log(spark, sf_dir), 4)
    q = ingest.start_ingest(stream, root, checkpoint=root + "-checkpoint", tz=TZ, coded=coded)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return root


def q_stream_ingest(spark, sf_dir):
    root = _run_stream(spark, sf_dir, coded=False)
    return store.read_attacks(spark, root).select(*KEY7)


def q_stream_ingest_coded(spark, sf_dir):
    root = _run_stream(spark, sf_dir, coded=True)
    fact, dicts = store.read_coded(spark, root)
    return dictionary.decode(fact.drop("date"), dicts).select(*KEY7)


def _run_restart(spark, sf_dir) -> str:
    """Half the input, then all of it under a new checkpoint, onto a store that
    a backfill began."""
    root = scratch_path(spark, "store")
    legacy = derived.legacy_records(spark, sf_dir)
    t = F.col("attack_timestamp")
    old = backfill_plan.clean_legacy(legacy.filter((t < F.lit(_ms(EARLY_END))) | (t > F.lit(8 * 10**18))))
    store.write_attacks(old, root, "overwrite")
    requests = derived.request_log(spark, sf_dir)
    for k, part in enumerate((requests.filter("event_id % 2 = 0"), requests)):
        stream = _staged(spark, part, 2)
        q = ingest.start_ingest(stream, root, checkpoint=f"{root}/_checkpoint-{k}", tz=TZ, log_lines=True)
        q.awaitTermination()
        if q.exception() is not None:
            raise RuntimeError(str(q.exception()))
    return root


def q_stream_ingest_restart(spark, sf_dir):
    """Counts of rows, ids, rejected bodies and log lines after a restart."""
    root = _run_restart(spark, sf_dir)
    stored = store.read_attacks(spark, root)
    kept = stored.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("id").alias("n_ids"))
    rejected = spark.read.parquet(f"{root}/rejected").agg(F.count_distinct("event_id").alias("n_rejected"))
    lines = spark.read.text(f"{root}/log").agg(F.count(F.lit(1)).alias("n_lines"))
    return kept.join(rejected, F.lit(True)).join(lines, F.lit(True))


def q_stream_ingest_restart_rows(spark, sf_dir):
    """The rows stored after a restart."""
    return store.read_attacks(spark, _run_restart(spark, sf_dir)).select(*KEY7)


def q_stream_ingest_restart_rejected(spark, sf_dir):
    """The bodies rejected by either run, and whether their event sent them."""
    rejected = spark.read.parquet(f"{_run_restart(spark, sf_dir)}/rejected")
    sent = derived.request_log(spark, sf_dir).select("event_id", "body").distinct().withColumn("own_body", F.lit(True))
    own = rejected.join(sent, ["event_id", "body"], "left")
    return own.select("event_id", "reason", F.coalesce("own_body", F.lit(False)).alias("own_body"))


def q_stream_ingest_restart_log(spark, sf_dir):
    """The log lines of both runs."""
    return spark.read.text(f"{_run_restart(spark, sf_dir)}/log").select(F.col("value").alias("line"))


def q_stream_ingest_bounded(spark, sf_dir):
    """The stored rows of the ingest with bounded state; all repeats arrive within its horizon."""
    root = scratch_path(spark, "store")
    stream = _staged(spark, derived.request_log(spark, sf_dir), 3)
    for q in ingest.start_bounded_ingest(stream, root, horizon="2 days", checkpoint=root + "-checkpoint", tz=TZ):
        q.awaitTermination()
        if q.exception() is not None:
            raise RuntimeError(str(q.exception()))
    return store.read_attacks(spark, root).select(*KEY7)


def q_stream_ingest_text(spark, sf_dir):
    """The stored rows of an ingest whose source is a stream of text files, a body a line."""
    path, root = scratch_path(spark, "bodies"), scratch_path(spark, "store")
    derived.request_log(spark, sf_dir).select("body").repartition(3).write.text(path)
    stream = submissions.read_submissions(spark, path, streaming=True, maxFilesPerTrigger=2)
    q = ingest.start_ingest(stream, root, checkpoint=root + "-checkpoint", tz=TZ)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return store.read_attacks(spark, root).select(*KEY7)


def _requests_without_time(spark, sf_dir) -> DataFrame:
    """The request log with the time left out of a third of the bodies."""
    bare = F.regexp_replace("body", '"attack_timestamp":"[^"]*",', "")
    timeless = (F.col("event_id") % 3 == 0) & (F.col("event_id") % 200 != 6)
    return derived.request_log(spark, sf_dir).withColumn("body", F.when(timeless, bare).otherwise(F.col("body")))


def q_stream_ingest_timeless(spark, sf_dir):
    """The stored rows of an ingest in which a third of the records have no time, all of it read twice."""
    requests, root = _requests_without_time(spark, sf_dir), scratch_path(spark, "store")
    for k in range(2):
        stream = _staged(spark, requests, 1 + k)
        q = ingest.start_ingest(stream, root, checkpoint=f"{root}/_checkpoint-{k}", tz=TZ)
        q.awaitTermination()
        if q.exception() is not None:
            raise RuntimeError(str(q.exception()))
    return store.read_attacks(spark, root).select(*KEY7)


def q_read_submissions(spark, sf_dir):
    """Bodies, one a line, read back from text files and decoded."""
    path = scratch_path(spark, "bodies")
    derived.request_log(spark, sf_dir).select("body").write.text(path)
    accepted, _ = submissions.decode(submissions.read_submissions(spark, path), tz=TZ)
    return submissions.clean(accepted).select(*KEY7).distinct()


def q_read_legacy(spark, sf_dir):
    path = scratch_path(spark, "legacy")
    derived.legacy_records(spark, sf_dir).write.parquet(path)
    return store.read_legacy(spark, path)


def q_credential_sources(spark, sf_dir):
    return views.credential_sources(derived.attack_records(spark, sf_dir), tz=TZ)


def _skewed(spark, sf_dir):
    """Attacks whose user names and passwords grow with the rows, one of each holding a third."""
    a = derived.attack_records(spark, sf_dir)
    name, word = (F.concat(F.lit(c), F.col("id").cast("string")) for c in ("u", "p"))
    hot = F.col("id") % 3 == 0
    return a.withColumns({"username": F.when(hot, F.lit("root")).otherwise(name), "password": F.when(hot, F.lit("hot")).otherwise(word)}).checkpoint(eager=True)


def q_encode_skewed(spark, sf_dir):
    attacks = _skewed(spark, sf_dir)
    return dictionary.encode(attacks, dictionary.build_dictionaries(attacks))


def q_encode_collapsed(spark, sf_dir):
    attacks = _skewed(spark, sf_dir)
    return dictionary.encode_collapsed(attacks, dictionary.build_dictionaries(attacks, stacked=True))


def q_decode_skewed(spark, sf_dir):
    attacks = _skewed(spark, sf_dir)
    dicts = dictionary.build_dictionaries(attacks)
    return dictionary.decode(dictionary.encode(attacks, dicts), dicts)


# all views are also registered over the stored table, read through its folders
STORED_VIEWS = list(views.VIEWS)
# and through SQL on the registered views
SQL_VIEWS = list(views.VIEWS)


def _stored_view_query(name: str, by_sql: bool) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        root = scratch_path(spark, "store")
        store.write_attacks(derived.attack_records(spark, sf_dir), root, "overwrite")
        attacks = store.read_attacks(spark, root)
        if by_sql:
            views.register_views(spark, attacks, as_of=AS_OF, tz=TZ)
            return spark.sql(f"SELECT * FROM {name}")
        return views.build_view(name, attacks, as_of=AS_OF, tz=TZ)

    run.__name__ = f"{'sql' if by_sql else 'stored'}_{name}"
    return run


# all views are also registered over the coded store (aggregate on ids, decode after)
CODED_VIEWS = list(views.VIEWS)


def _coded_store(spark: SparkSession, sf_dir: str):
    """Coded fact + dictionaries of the attacks, each built once."""
    attacks = derived.attack_records(spark, sf_dir).checkpoint(eager=True)
    dicts = dictionary.build_dictionaries(attacks)
    return dictionary.encode(attacks, dicts), dicts


def _coded_view_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        fact, dicts = _coded_store(spark, sf_dir)
        return coded_views.coded_view(name, fact, dicts, as_of=AS_OF, tz=TZ)

    run.__name__ = f"coded_{name}"
    return run


def _rolled_store(spark: SparkSession, sf_dir: str, coded: bool) -> str:
    """An ingest that keeps minute counts, and after it a restart that reads all again
    and more and keeps none, so that a part of the rows is covered by no count yet."""
    requests, root = derived.request_log(spark, sf_dir), scratch_path(spark, "store")
    for k, part in enumerate((requests.filter("event_id % 3 > 0"), requests)):
        stream = _staged(spark, part, 2 - k)
        q = ingest.start_ingest(stream, root, checkpoint=f"{root}/_checkpoint-{k}", tz=TZ, coded=coded, minutes=not k)
        q.awaitTermination()
        if q.exception() is not None:
            raise RuntimeError(str(q.exception()))
    return root


def _rolled_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    coded = name == "view_daily_attacks"  # one of them over the coded store

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        root = _rolled_store(spark, sf_dir, coded)
        return rollup.VIEWS[name](spark, root, as_of=AS_OF, tz=TZ, table="fact" if coded else "attacks")

    run.__name__ = f"rolled_{name}"
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: _view_query(name) for name in views.VIEWS}
    out.update({f"coded_{name}": _coded_view_query(name) for name in CODED_VIEWS})
    out.update({f"stored_{name}": _stored_view_query(name, False) for name in STORED_VIEWS})
    out.update({f"sql_{name}": _stored_view_query(name, True) for name in SQL_VIEWS})
    out.update({f"rolled_{name}": _rolled_query(name) for name in rollup.VIEWS})
    out.update(
        {
            "decode_submissions": q_decode_submissions,
            "rejected_submissions": q_rejected_submissions,
            "dedup_submissions": q_dedup_submissions,
            "drop_seen_attacks": q_drop_seen_attacks,
            "drop_incomplete_legacy": q_drop_incomplete_legacy,
            "trim_evidence": q_trim_evidence,
        }
    )
    for c in TEXT_COLUMNS:
        out[f"dictionary_{c}s"] = _dictionary_query(c)
    out["extend_dictionary_usernames"] = _extend_query("username")
    out["extend_dictionary_passwords"] = _extend_query("password")
    out.update(
        {
            "encode_attacks": q_encode_attacks,
            "decode_attacks": q_decode_attacks,
            "backfill_attacks": q_backfill_attacks,
            "log_lines": q_log_lines,
            "stream_ingest": q_stream_ingest,
            "stream_ingest_coded": q_stream_ingest_coded,
            "stream_ingest_restart": q_stream_ingest_restart,
            "stream_ingest_restart_rows": q_stream_ingest_restart_rows,
            "stream_ingest_restart_rejected": q_stream_ingest_restart_rejected,
            "stream_ingest_restart_log": q_stream_ingest_restart_log,
            "stream_ingest_bounded": q_stream_ingest_bounded,
            "stream_ingest_text": q_stream_ingest_text,
            "stream_ingest_timeless": q_stream_ingest_timeless,
            "read_submissions": q_read_submissions,
            "read_legacy": q_read_legacy,
            "credential_sources": q_credential_sources,
            "encode_skewed_attacks": q_encode_skewed,
            "encode_collapsed_attacks": q_encode_collapsed,
            "decode_skewed_attacks": q_decode_skewed,
        }
    )
    return out


# ---------------------------------------------------------------------------
# Oracle SQL (DuckDB dialect), written from the view definitions
# ---------------------------------------------------------------------------

_SUB = """
sub AS (
  SELECT event_id,
         epoch_us(ts) // 1000 AS "timestamp",
         '10.0.' || CAST(user_id // 256 AS VARCHAR) || '.' || CAST(user_id % 256 AS VARCHAR) AS source_ip,
         '192.0.2.' || CAST(event_id % 5 + 1 AS VARCHAR) AS destination_ip,
         'user' || CAST(user_id % 37 AS VARCHAR) AS username,
         'pw' || json_extract_string(props, '$.k') || '-' || CAST(event_id % 7 AS VARCHAR) AS password,
         event_type AS attack_type,
         chr(9) || ' ' || event_type || ' #' || CAST(event_id % 11 AS VARCHAR) || chr(10) AS evidence,
         event_id % 100 = 99 AS test_mode
  FROM events
),
resub AS (
  SELECT * FROM sub UNION ALL SELECT * FROM sub WHERE event_id % 10 = 3
)"""

_ATTACKS = _SUB + """,
clean AS (
  SELECT event_id + 1 AS id, "timestamp", source_ip, destination_ip, username, password, attack_type,
         trim(evidence, ' ' || chr(9) || chr(10) || chr(13)) AS evidence
  FROM resub WHERE NOT test_mode
),
attacks AS (
  SELECT min(id) AS id, "timestamp", source_ip, destination_ip, username, password, attack_type, evidence
  FROM clean
  GROUP BY "timestamp", source_ip, destination_ip, username, password, attack_type, evidence
),
timed AS (
  SELECT *, make_timestamp(("timestamp" // 1000) * 1000000) AS t FROM attacks
)
"""

_SEP = " <-| username @ password |-> "


def _with(body: str) -> str:
    return "WITH " + _ATTACKS + body


def _fmt(dt: _dt.datetime, fmt: str) -> str:
    return dt.strftime(fmt)


def _cut_ms(days: int) -> int:
    return (int(_AS_OF_DT.timestamp()) - days * 86400) * 1000


def _local_cut(days: int, fmt: str) -> str:
    # TZ is UTC for the registered queries
    return _fmt((_AS_OF_DT - _dt.timedelta(days=days)).astimezone(_dt.timezone.utc), fmt)


_TS = "strftime(t, '%Y-%m-%d %H:%M:%S')"
_DATE = "strftime(t, '%Y-%m-%d')"


def _view_sql() -> dict[str, str]:
    q = {}
    for key in ["username", "password", "source_ip"]:
        q[f"view_{key}s"] = _with(f"SELECT {key}, count(*) AS count FROM attacks GROUP BY {key}")
    q["view_log"] = _with(f"SELECT {_TS} AS time, source_ip AS source, username, password FROM timed")
    q["view_daily_attacks"] = _with(f"SELECT {_DATE} AS date, count(*) AS count FROM timed GROUP BY 1")
    for key in ["username", "password", "source_ip"]:
        q[f"view_daily_{key}s"] = _with(
            f"SELECT {_DATE} AS date, {key}, count(*) AS count FROM timed GROUP BY 1, 2"
        )
    q["view_attacks_by_time"] = _with(
        "SELECT strftime(t, '%Y-%m-%d') AS date, strftime(t, '%m') AS month, "
        "strftime(t, '%W') AS week_of_year, strftime(t, '%w') AS weekday, "
        "strftime(t, '%d') AS day_of_month, strftime(t, '%H') AS hour_of_day, "
        "strftime(t, '%M') AS minute_of_hour, count(*) AS count FROM timed GROUP BY ALL"
    )
    q["view_logins"] = _with("SELECT username, password, count(*) AS count FROM attacks GROUP BY 1, 2")
    q["view_attack_patterns_by_source"] = _with(
        "SELECT source_ip, count(*) AS total_attacks, count(DISTINCT username) AS unique_usernames, "
        "count(DISTINCT password) AS unique_passwords, "
        f"count(DISTINCT username || '{_SEP}' || password) AS unique_logins, "
        f"min({_TS}) AS first_seen, max({_TS}) AS last_seen FROM timed GROUP BY source_ip"
    )
    fp = (
        "SELECT username, password, count(*) AS total_uses, count(DISTINCT source_ip) AS distinct_source_ips, "
        f"min({_TS}) AS first_seen, max({_TS}) AS last_seen, "
        "string_agg(DISTINCT source_ip, ',' ORDER BY source_ip) AS source_ips FROM timed GROUP BY 1, 2"
    )
    q["view_credential_fingerprints"] = _with(fp)
    q["report_new_credential_fingerprints_last_7_days"] = _with(
        f", fp AS ({fp}) SELECT * FROM fp WHERE distinct_source_ips = 1 "
        f"AND first_seen >= '{_local_cut(7, '%Y-%m-%d %H:%M:%S')}'"
    )
    tops = {
        "report_top_attackers_last_24_hours": (["source_ip"], 1),
        "report_top_usernames_last_7_days": (["username"], 7),
        "report_top_passwords_last_7_days": (["password"], 7),
        "report_top_logins_last_7_days": (["username", "password"], 7),
    }
    for name, (keys, days) in tops.items():
        k = ", ".join(keys)
        q[name] = _with(
            f"SELECT {k}, count(*) AS count FROM attacks WHERE \"timestamp\" >= {_cut_ms(days)} "
            f"GROUP BY {k} ORDER BY count DESC, {k} LIMIT 20"
        )
    q["view_attack_spread_by_username"] = _with(
        "SELECT username, count(*) AS total_attempts, count(DISTINCT source_ip) AS distinct_attackers "
        "FROM attacks GROUP BY username"
    )
    q["report_hourly_attacks_last_7_days"] = _with(
        ", byminute AS (SELECT strftime(t, '%Y-%m-%d') AS date, strftime(t, '%H') AS hour_of_day, "
        "strftime(t, '%M') AS minute_of_hour, count(*) AS count FROM timed GROUP BY ALL), "
        "hourly AS (SELECT date || ' ' || hour_of_day || ':00:00' AS time, CAST(sum(count) AS BIGINT) AS total_attacks "
        "FROM byminute GROUP BY date, hour_of_day) "
        "SELECT time AS from_time, strftime(CAST(time AS TIMESTAMP) + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS to_time, "
        f"total_attacks FROM hourly WHERE time >= '{_local_cut(7, '%Y-%m-%d %H:00:00')}'"
    )
    q["report_daily_attacks_last_90_days"] = _with(
        ", byminute AS (SELECT strftime(t, '%Y-%m-%d') AS date, strftime(t, '%H') AS hour_of_day, "
        "strftime(t, '%M') AS minute_of_hour, count(*) AS count FROM timed GROUP BY ALL), "
        "daily AS (SELECT date || ' 00:00:00' AS time, CAST(sum(count) AS BIGINT) AS total_attacks "
        "FROM byminute GROUP BY date) "
        "SELECT time AS from_time, strftime(CAST(time AS TIMESTAMP) + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS to_time, "
        f"total_attacks FROM daily WHERE time >= '{_local_cut(90, '%Y-%m-%d 00:00:00')}'"
    )
    return q


_UNICODE_TRIM = " || ".join(
    f"chr({c})" for c in [9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
)

def _submitted(routed: str) -> str:
    return _SUB + f""",
submitted AS (
  SELECT event_id, CASE WHEN event_id % 200 = 55 THEN -62135596800000 ELSE "timestamp" END AS "timestamp",
         source_ip, destination_ip, username, password, attack_type,
         trim(evidence, {_UNICODE_TRIM}) AS evidence
  FROM resub
  WHERE {routed} AND event_id % 200 NOT IN (5, 6, 15, 25, 35) AND NOT test_mode
)
"""


_SUBMITTED = _submitted("event_id % 40 NOT IN (11, 21)")

_LEGACY = _SUB + """,
legacy AS (
  SELECT 2 * event_id + 1 AS id, source_ip, destination_ip,
         CASE WHEN event_id % 50 = 7 THEN NULL ELSE username END AS username,
         password, CASE WHEN event_id % 200 = 14 THEN 9000000000000000000 ELSE "timestamp" END AS attack_timestamp, evidence, attack_type
  FROM sub
  UNION ALL
  SELECT 2 * event_id + 2 AS id, source_ip, destination_ip,
         CASE WHEN event_id % 50 = 7 THEN NULL ELSE username END AS username,
         password, CASE WHEN event_id % 200 = 14 THEN 9000000000000000000 ELSE "timestamp" END AS attack_timestamp, evidence, attack_type
  FROM sub WHERE event_id % 10 = 3
)
"""

_K7 = '"timestamp", source_ip, destination_ip, username, password, attack_type, evidence'


def _dict_cte(column: str, source: str = "attacks", name: str | None = None) -> str:
    name = name or f"d_{column}"
    return (
        f"{name} AS (SELECT dense_rank() OVER (ORDER BY value) AS id, value FROM "
        f"(SELECT DISTINCT {column} AS value FROM {source} WHERE {column} IS NOT NULL))"
    )


def _encode_select(source: str) -> str:
    joins = " ".join(f"JOIN d_{c} ON d_{c}.value = s.{c}" for c in _TEXT)
    cols = ", ".join(f"d_{c}.id AS {c}" for c in _TEXT)
    return f'SELECT s.id, s."timestamp", {cols} FROM {source} s {joins}'


_TEXT = ["source_ip", "destination_ip", "username", "password", "attack_type", "evidence"]


def _operator_sql() -> dict[str, str]:
    q = {}
    q["decode_submissions"] = f"WITH {_SUBMITTED} SELECT event_id, {_K7} FROM submitted"
    q["rejected_submissions"] = (
        f"WITH {_SUB} SELECT event_id, CASE WHEN event_id % 200 = 6 THEN 'bad_attack_timestamp' "
        "ELSE 'not_json_object' END AS reason FROM resub "
        "WHERE event_id % 40 NOT IN (11, 21) AND event_id % 200 IN (5, 6, 15, 25, 35)"
    )
    q["dedup_submissions"] = (
        f"WITH {_SUBMITTED} SELECT min(event_id + 1) AS id, {_K7} FROM submitted GROUP BY {_K7}"
    )
    q["drop_seen_attacks"] = _with(
        f", stored AS (SELECT * FROM attacks WHERE \"timestamp\" < {_ms(HISTORY_END)}), "
        + _SUBMITTED.replace(_SUB, "", 1).lstrip(",\n")
        + f" SELECT event_id, {_K7} FROM submitted n WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE "
        + " AND ".join(f's."{c}" = n."{c}"' for c in ["timestamp", *_TEXT])
        + ")"
    )
    q["drop_incomplete_legacy"] = (
        f"WITH {_LEGACY} SELECT * FROM legacy WHERE "
        + " AND ".join(f"{c} IS NOT NULL" for c in [*_TEXT, "attack_timestamp"])
    )
    q["trim_evidence"] = (
        f"WITH {_LEGACY} SELECT id, trim(evidence, ' ' || chr(9) || chr(10) || chr(13)) AS evidence FROM legacy"
    )
    for c in _TEXT:
        q[f"dictionary_{c}s"] = _with(f", {_dict_cte(c, name='d')} SELECT id, value FROM d")
    for c in ["username", "password"]:
        q[f"extend_dictionary_{c}s"] = _with(
            f", early AS (SELECT * FROM attacks WHERE \"timestamp\" < {_ms(EARLY_END)}), "
            f"{_dict_cte(c, 'early', 'old')}, "
            f"fresh AS (SELECT DISTINCT {c} AS value FROM attacks WHERE {c} IS NOT NULL "
            f"AND {c} NOT IN (SELECT value FROM old)) "
            "SELECT id, value FROM old UNION ALL "
            "SELECT (SELECT coalesce(max(id), 0) FROM old) + dense_rank() OVER (ORDER BY value) AS id, value FROM fresh"
        )
    dicts = ", ".join(_dict_cte(c) for c in _TEXT)
    q["encode_attacks"] = _with(f", {dicts} " + _encode_select("attacks"))
    q["decode_attacks"] = _with(f"SELECT id, {_K7} FROM attacks")
    q["backfill_attacks"] = (
        f"WITH {_LEGACY}, cleaned AS (SELECT min(id) AS id, attack_timestamp AS \"timestamp\", source_ip, "
        "destination_ip, username, password, attack_type, "
        "trim(evidence, ' ' || chr(9) || chr(10) || chr(13)) AS evidence FROM legacy WHERE "
        + " AND ".join(f"{c} IS NOT NULL" for c in [*_TEXT, "attack_timestamp"])
        + " GROUP BY 2, 3, 4, 5, 6, 7, 8), "
        + ", ".join(_dict_cte(c, "cleaned") for c in _TEXT)
        + " "
        + _encode_select("cleaned")
    )
    q["log_lines"] = _with(
        "SELECT id, printf('%s | From: %-15s | User: %-22s | Pass: %s', "
        "strftime(t, '%d.%m. %H:%M:%S'), source_ip, username, password) AS line FROM timed"
    )
    stream = f"WITH {_SUBMITTED} SELECT DISTINCT {_K7} FROM submitted"
    q["stream_ingest"] = stream
    q["stream_ingest_coded"] = stream
    legacy_old = (
        "old AS (SELECT DISTINCT attack_timestamp AS \"timestamp\", source_ip, destination_ip, username, password, attack_type, "
        "trim(evidence, ' ' || chr(9) || chr(10) || chr(13)) AS evidence FROM legacy WHERE "
        + " AND ".join(f"{c} IS NOT NULL" for c in _TEXT)
        + f" AND (attack_timestamp < {_ms(EARLY_END)} OR attack_timestamp > 8000000000000000000))"
    )
    q["stream_ingest_restart"] = (
        f"WITH {_SUBMITTED}, {_LEGACY.replace(_SUB, '', 1).lstrip(chr(44) + chr(10))}, {legacy_old}, "
        f"every AS (SELECT {_K7} FROM old UNION SELECT {_K7} FROM submitted) "
        "SELECT (SELECT count(*) FROM every) AS n_rows, (SELECT count(*) FROM every) AS n_ids, "
        "(SELECT count(DISTINCT event_id) FROM resub WHERE event_id % 40 NOT IN (11, 21) AND event_id % 200 IN (5, 6, 15, 25, 35)) AS n_rejected, "
        "(SELECT count(*) FROM every) - (SELECT count(*) FROM old) AS n_lines"
    )
    restart = f"WITH {_SUBMITTED}, {_LEGACY.replace(_SUB, '', 1).lstrip(chr(44) + chr(10))}, {legacy_old} "
    q["stream_ingest_restart_rows"] = restart + f"SELECT {_K7} FROM old UNION SELECT {_K7} FROM submitted"
    bad = "event_id % 40 NOT IN (11, 21) AND event_id % 200 IN (5, 6, 15, 25, 35)"
    reason = "CASE WHEN event_id % 200 = 6 THEN 'bad_attack_timestamp' ELSE 'not_json_object' END AS reason, TRUE AS own_body"
    q["stream_ingest_restart_rejected"] = (
        f"WITH {_SUB} SELECT event_id, {reason} FROM resub WHERE {bad} "
        f"UNION ALL SELECT event_id, {reason} FROM resub WHERE {bad} AND event_id % 2 = 0"
    )
    q["stream_ingest_restart_log"] = restart + (
        "SELECT printf('%s | From: %-15s | User: %-22s | Pass: %s', strftime(make_timestamp(\"timestamp\" * 1000), '%d.%m. %H:%M:%S'), "
        f"source_ip, username, password) AS line FROM (SELECT {_K7} FROM submitted EXCEPT SELECT {_K7} FROM old)"
    )
    q["read_submissions"] = f"WITH {_submitted('TRUE')} SELECT DISTINCT {_K7} FROM submitted"
    q["stream_ingest_bounded"] = stream
    q["stream_ingest_text"] = q["read_submissions"]
    k7_bare = _K7.replace('"timestamp"', 'CASE WHEN event_id % 3 = 0 THEN -62135596800000 ELSE "timestamp" END AS "timestamp"', 1)
    q["stream_ingest_timeless"] = f"WITH {_SUBMITTED} SELECT DISTINCT {k7_bare} FROM submitted"
    q["read_legacy"] = f"WITH {_LEGACY} SELECT * FROM legacy"
    q["credential_sources"] = _with(
        f"SELECT username, password, source_ip, count(*) AS uses, min({_TS}) AS first_seen, max({_TS}) AS last_seen FROM timed GROUP BY 1, 2, 3"
    )
    skewed = (
        ", skewed AS (SELECT id, \"timestamp\", source_ip, destination_ip, CASE WHEN id % 3 = 0 THEN 'root' ELSE 'u' || id END AS username, "
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE 'p' || id END AS password, attack_type, evidence FROM attacks)"
    )
    q["encode_skewed_attacks"] = _with(skewed + ", " + ", ".join(_dict_cte(c, "skewed") for c in _TEXT) + " " + _encode_select("skewed"))
    q["encode_collapsed_attacks"] = q["encode_skewed_attacks"]
    q["decode_skewed_attacks"] = _with(skewed + f" SELECT id, {_K7} FROM skewed")
    return q


def oracle_sql() -> dict[str, str]:
    plain = _view_sql()
    out = dict(plain)
    out.update({f"coded_{name}": plain[name] for name in CODED_VIEWS})
    out.update({f"stored_{name}": plain[name] for name in STORED_VIEWS})
    out.update({f"sql_{name}": plain[name] for name in SQL_VIEWS})
    ingested = (
        _SUBMITTED + f", attacks AS (SELECT DISTINCT {_K7} FROM submitted), "
        'timed AS (SELECT *, make_timestamp(("timestamp" // 1000) * 1000000) AS t FROM attacks)\n'
    )
    out.update({f"rolled_{name}": plain[name].replace(_ATTACKS, ingested, 1) for name in rollup.VIEWS})
    out.update(_operator_sql())
    return out
