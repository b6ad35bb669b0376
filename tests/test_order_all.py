"""The order of each of the twenty views, and that a written table keeps it file by file."""

import pytest

from trapline.plans import views
from trapline.session import scratch_path

NOW = 1706659200
#: each view's order: a column, or a column with "-" for descending; view_log shows no id, its ties are tested elsewhere
ORDERS = {
    "view_usernames": ["-count", "username"],
    "view_passwords": ["-count", "password"],
    "view_source_ips": ["-count", "source_ip"],
    "view_log": ["-time"],
    "view_daily_attacks": ["-date"],
    "view_daily_usernames": ["-date", "-count", "username"],
    "view_daily_passwords": ["-date", "-count", "password"],
    "view_daily_source_ips": ["-date", "-count", "source_ip"],
    "view_attacks_by_time": ["date", "hour_of_day", "minute_of_hour"],
    "view_logins": ["-count", "username", "password"],
    "view_attack_patterns_by_source": ["-total_attacks", "source_ip"],
    "view_credential_fingerprints": ["distinct_source_ips", "-total_uses", "-last_seen", "username", "password"],
    "report_top_attackers_last_24_hours": ["-count", "source_ip"],
    "report_top_usernames_last_7_days": ["-count", "username"],
    "report_top_passwords_last_7_days": ["-count", "password"],
    "report_new_credential_fingerprints_last_7_days": ["distinct_source_ips", "-total_uses", "-last_seen", "username", "password"],
    "view_attack_spread_by_username": ["-total_attempts", "-distinct_attackers", "username"],
    "report_hourly_attacks_last_7_days": ["from_time"],
    "report_daily_attacks_last_90_days": ["from_time"],
    "report_top_logins_last_7_days": ["-count", "username", "password"],
}


@pytest.fixture(scope="module")
def attacks(spark):
    # 60 minutes apart, over 25 days; many ties
    return spark.range(600).selectExpr(
        "id + 1 AS id", f"({NOW} - id * 3600) * 1000 AS timestamp", "concat('s', id * id % 13) AS source_ip", "'d' AS destination_ip",
        "concat('u', id * 7 % 29) AS username", "concat('p', id * id % 17) AS password", "'t' AS attack_type", "'e' AS evidence").repartition(5).checkpoint()


@pytest.fixture(scope="module", autouse=True)
def folder(spark):
    scratch_path(spark, "test-order-all")  # the session has a checkpoint folder


def _sorted(rows, order):
    for column in reversed(order):  # stable: the last key first
        rows = sorted(rows, key=lambda r: r[column.lstrip("-")], reverse=column.startswith("-"))
    return rows


def _keys(rows, order):
    return [tuple(r[c.lstrip("-")] for c in order) for r in rows]


def test_every_view_is_here():
    assert set(ORDERS) == set(views.VIEWS)


@pytest.mark.parametrize("name", list(ORDERS))
def test_rows_come_in_order(spark, attacks, name):
    order = ORDERS[name]
    rows = views.build_view(name, attacks, as_of=NOW, tz="UTC").collect()
    assert len(rows) > 1
    assert _keys(rows, order) == _keys(_sorted(rows, order), order)


@pytest.mark.parametrize("name", ["view_daily_usernames", "report_hourly_attacks_last_7_days"])
def test_written_files_follow_one_another(spark, attacks, name):
    path, order = scratch_path(spark, "test-ordered"), ORDERS[name]
    views.build_view(name, attacks, as_of=NOW, tz="UTC").write.parquet(path)
    # part-00000, part-00001, ...: each file in order, and the files one after the other
    files = sorted(r["file"] for r in spark.read.parquet(path).selectExpr("input_file_name() AS file").distinct().collect())
    rows = [r for f in files for r in spark.read.parquet(f).coalesce(1).collect()]
    assert _keys(rows, order) == _keys(_sorted(rows, order), order)
