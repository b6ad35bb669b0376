"""A key holding most rows gives the same results as a brute-force count."""

from collections import Counter


from trapline.operators import dedup
from trapline.plans import views


def _skewed(spark, n=20000):
    # 2/3 of rows share user 'root', password '123456'; sources spread widely
    rows = []
    for i in range(n):
        hot = i % 3 != 0
        rows.append((i + 1, 1706000000000 + i * 1000, f"10.{i % 7}.{i % 251}.{i % 13}", "d",
                     "root" if hot else f"u{i % 50}", "123456" if hot else f"p{i % 40}", "ssh", "e"))
    schema = ("id long, timestamp long, source_ip string, destination_ip string, username string, "
              "password string, attack_type string, evidence string")
    return rows, spark.createDataFrame(rows, schema).repartition(8)


def test_hot_credential_counts(spark):
    rows, df = _skewed(spark)
    spread = {r["username"]: (r["total_attempts"], r["distinct_attackers"])
              for r in views.view_attack_spread_by_username(df).collect()}
    want_total = Counter(r[4] for r in rows)
    want_src = {u: len({r[2] for r in rows if r[4] == u}) for u in want_total}
    assert spread == {u: (want_total[u], want_src[u]) for u in want_total}
    fp = {(r["username"], r["password"]): r for r in views.view_credential_fingerprints(df, tz="UTC").collect()}
    hot_src = sorted({r[2] for r in rows if r[4] == "root"})
    assert fp[("root", "123456")]["source_ips"] == ",".join(hot_src)
    assert fp[("root", "123456")]["total_uses"] == want_total["root"]


def test_hot_duplicate_collapses(spark):
    # one record resent 30000 times plus distinct rows
    dup = [(i, 5, "x") for i in range(30000)]
    other = [(30000 + i, i, "y") for i in range(100)]
    df = spark.createDataFrame(dup + other, "id long, k long, v string").repartition(8)
    out = dedup.dedup_keep_first(df, ["k", "v"], "id")
    got = {(r["k"], r["v"]): r["id"] for r in out.collect()}
    assert len(got) == 101 and got[(5, "x")] == 0
