"""The twenty views over a dictionary-coded store: aggregate on ids, decode after.

Reading views through a fully decoded ``attacks`` frame joins all six
dictionaries to every fact row. Since each dictionary maps values to ids one
to one, counts and distinct counts on ids equal those on values. So here
every view groups the coded fact on its bigint id columns (narrow rows, cheap
shuffles), and joins only the dictionaries it shows, only onto the reduced
result. Views that show no text column never decode at all. Orders that
depend on text are applied after decoding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dictionary
from ..operators.filters import since
from ..schema import LOGIN_SEPARATOR, TEXT_COLUMNS
from . import views as V

TOP_N = V.TOP_N


def _decode(df: DataFrame, dicts, columns) -> DataFrame:
    return dictionary.decode(df, dicts, columns=columns)


def _count_by(fact: DataFrame, dicts, keys) -> DataFrame:
    agg = fact.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
    return _decode(agg, dicts, keys).orderBy(F.desc("count"), *[F.asc(k) for k in keys])


def _top(fact: DataFrame, dicts, keys, as_of, days: int, n: int) -> DataFrame:
    agg = since(fact, as_of, days).groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
    return _decode(agg, dicts, keys).orderBy(F.desc("count"), *[F.asc(k) for k in keys]).limit(n)


def _daily(fact: DataFrame, dicts, key: str, tz) -> DataFrame:
    return V.daily_from_stage(_decode(V.daily_stage(fact, key, tz), dicts, [key]), key)


def _separator_in(dicts) -> bool:
    """Whether a user name or password holds the separator of logins (one look at two dictionaries)."""
    values = dicts["username"].select("value").unionByName(dicts["password"].select("value"))
    return bool(values.agg(F.bool_or(V.login_is_odd("value", "value")).alias("odd")).first()["odd"])


def _patterns(fact, dicts, tz):
    # pairs of ids are as different as their logins, but for values that hold the separator
    stage, ids = V.source_login_stage(fact, tz), not _separator_in(dicts)
    stage = stage if ids else _decode(stage, dicts, ["username", "password"])
    return V.attack_patterns_in_order(_decode(V.patterns_by_source(stage, ids), dicts, ["source_ip"]))


def _fingerprints(fact, dicts, tz):
    # the list shows addresses, so these are decoded before it is made; credentials after it
    stage = _decode(V.credential_source_stage(fact, tz), dicts, ["source_ip"])
    decoded = _decode(V.fingerprints_from_stage(stage), dicts, ["username", "password"])
    return V._fingerprint_order(decoded).select(*V._FINGERPRINT_COLUMNS)


def _new_fingerprints(fact, dicts, as_of, tz, days: int = 7):
    # filter on ids first (single source: its min id is that source), then
    # decode only the surviving rows
    on_ids = V.new_fingerprints_from_stage(V.credential_source_stage(fact, tz), as_of, tz, days)
    named = on_ids.withColumnRenamed("source_ips", "source_ip")
    decoded = _decode(named, dicts, ["username", "password", "source_ip"])
    return V._fingerprint_order(decoded.withColumnRenamed("source_ip", "source_ips")).select(
        *V._FINGERPRINT_COLUMNS
    )


def _spread(fact, dicts):
    per_src = fact.groupBy("username", "source_ip").agg(F.count(F.lit(1)).alias("_n"))
    agg = per_src.groupBy("username").agg(
        F.sum("_n").alias("total_attempts"), F.count("source_ip").alias("distinct_attackers")
    )
    return _decode(agg, dicts, ["username"]).orderBy(
        F.desc("total_attempts"), F.desc("distinct_attackers"), F.asc("username")
    )


def coded_view(name: str, fact: DataFrame, dicts: dict, as_of=None, tz: str | None = None,
               n: int = TOP_N) -> DataFrame:
    """View ``name`` over coded ``fact`` (ids) and its ``dicts``."""
    if name in ("view_usernames", "view_passwords", "view_source_ips"):
        return _count_by(fact, dicts, [name[len("view_"):-1]])
    if name == "view_logins":
        return _count_by(fact, dicts, ["username", "password"])
    if name == "view_log":
        return V.view_log(_decode(fact, dicts, ["source_ip", "username", "password"]), tz=tz)
    if name in ("view_daily_attacks", "view_attacks_by_time", "report_hourly_attacks_last_7_days",
                "report_daily_attacks_last_90_days"):
        return V.build_view(name, fact, as_of=as_of, tz=tz)  # time only: no decode
    if name.startswith("view_daily_"):
        return _daily(fact, dicts, name[len("view_daily_"):-1], tz)
    if name == "view_attack_patterns_by_source":
        return _patterns(fact, dicts, tz)
    if name == "view_credential_fingerprints":
        return _fingerprints(fact, dicts, tz)
    if name == "report_new_credential_fingerprints_last_7_days":
        return _new_fingerprints(fact, dicts, as_of, tz)
    if name == "view_attack_spread_by_username":
        return _spread(fact, dicts)
    tops = {
        "report_top_attackers_last_24_hours": (["source_ip"], 1),
        "report_top_usernames_last_7_days": (["username"], 7),
        "report_top_passwords_last_7_days": (["password"], 7),
        "report_top_logins_last_7_days": (["username", "password"], 7),
    }
    if name in tops:
        keys, days = tops[name]
        return _top(fact, dicts, keys, as_of, days, n)
    raise KeyError(name)


def register_coded_views(spark, fact: DataFrame, dicts: dict, as_of=None, tz: str | None = None) -> dict:
    """Register ``attacks`` (decoded) and the twenty views over a coded store
    as temporary views; "now" as in ``views.register_views``."""
    attacks = _decode(fact, dicts, list(TEXT_COLUMNS))
    attacks.createOrReplaceTempView("attacks")
    out = {"attacks": attacks}
    for name in V.VIEWS:
        df = coded_view(name, fact, dicts, as_of=as_of, tz=tz)
        df.createOrReplaceTempView(name)
        out[name] = df
    return out
