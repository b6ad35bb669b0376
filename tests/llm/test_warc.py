import gzip
import hashlib

import pytest
from llm_cases import SF

from trapline.llm import queries, warc
from trapline.llm.shipping import prepare
from trapline.session import scratch_path

PAGES = "page_id long, url string, html string"


def pages(spark):
    prepare(spark)
    big, other = "<p>x</p>" * 200, "<b>é</b>" * 300
    rows = [(3, "http://a/3", big), (1, "http://a/1", big), (7, "http://a b/\r\nX: 1", big), (2, None, None), (None, "http://n", big), (4, "u", ""), (5, "u", "small"), (6, "u", "small"),
            (8, "u", other), (8, "u2", other), (9, "u", other[:-1]), (10, "u", big * 400), (11, "u", "a\r\n\r\nWARC/1.1\r\n" * 100), (7, "http://a/7", big)]
    return spark.createDataFrame([(*r, "own") for r in rows], PAGES + ", tag string"), rows


def expected(rows):
    data = [(p, (h or "").encode()) for p, _, h in rows]
    most = {}
    for p, b in data:
        if len(b) >= 1000 and p is not None:
            most[b] = max(most.get(b, p), p)
    copies = {b: sum(x == b for _, x in data) for _, b in data}
    out = []
    for p, b in data:
        keeper = most.get(b) if copies[b] > 1 else None
        revisit = keeper is not None and p != keeper
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", keeper if revisit else None))
    return sorted(out, key=repr)


def test_round_trip_with_small_files(spark):
    table, rows = pages(spark)
    root = scratch_path(spark, "warc-test")
    manifest = warc.write(table, root, roll_bytes=600).collect()
    assert len(manifest) > 3 and sum(m["records"] for m in manifest) == len(rows)
    back = warc.read(spark, root).collect()
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in back), key=repr)
    assert got == expected(rows)
    texts = sorted((h or "").encode() for _, _, h in rows)
    whole = {hashlib.sha1(t).hexdigest(): t for t in texts}
    for r in back:
        assert (r["payload"] is None) if r["record_type"] == "revisit" else bytes(r["payload"]) == whole[r["payload_digest"]]


def test_equal_input_gives_equal_files(spark):
    table, _ = pages(spark)
    one, two = (sorted((m["file"], m["sha1"]) for m in warc.write(t, scratch_path(spark, "warc-test")).collect()) for t in (table, table.repartition(3)))
    assert one == two


@pytest.mark.parametrize("n", [3000, 7500])
def test_many_rows_give_equal_files_however_they_are_dealt_out(spark, n):
    """More rows than Spark's own range sample looks at; a third of them without an id."""
    prepare(spark)
    table = spark.range(n).selectExpr("CASE WHEN id % 3 > 0 THEN id * 7919 % 100003 END AS page_id", "concat('http://h/', id) AS url", "repeat(concat('<p>', id % 1000), 30) AS html")
    found = []
    for t in (table, table.repartition(3), table.repartition(7, "url"), table):
        found.append(sorted((m["file"], m["records"], m["bytes"], m["sha1"]) for m in warc.write(t, scratch_path(spark, "warc-test"), roll_bytes=20_000).collect()))
    assert found[0] == found[1] == found[2] == found[3]
    parts = {}
    for name, records, _, _ in found[0]:
        parts[name[:15]] = parts.get(name[:15], 0) + records
    assert sum(parts.values()) == n and max(parts.values()) < n / 4


def test_a_file_of_an_earlier_attempt_is_replaced(tmp_path):
    for text in (b"first", b"second"):
        writer = warc._Writer(str(tmp_path), 0, 1 << 20)
        writer.add(text)
        writer.close()
    (name,) = (tmp_path / "data").iterdir()
    assert gzip.decompress(name.read_bytes()).endswith(b"second")


def test_files_are_warc(spark):
    table, rows = pages(spark)
    root = scratch_path(spark, "warc-test")
    names = [m["file"] for m in warc.write(table, root).collect()]
    fs, path = warc.store(root)
    text = b"".join(gzip.decompress(fs.open_input_stream(f"{path}/{n}", compression=None).read()) for n in names)
    assert text.startswith(b"WARC/1.1\r\n") and text.count(b"WARC-Record-ID: <urn:uuid:") == len(rows) + len(names)
    assert b"\r\nX: 1" not in text  # a URL cannot add headers


def test_damage_is_found():
    record = warc.page_record(1, "u", b"payload", 7, hashlib.sha1(b"payload").hexdigest(), None, 0)
    assert warc.parse(record)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parse(record.replace(b"payload\r\n\r\n", b"pAyload\r\n\r\n"))


def test_empty(spark):
    prepare(spark)
    root = scratch_path(spark, "warc-test")
    assert warc.write(spark.createDataFrame([], PAGES), root).collect() == []
    assert warc.read(spark, root).collect() == []


def test_query(spark):
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    got = sorted((tuple(r) for r in queries.op3_warc(spark, SF).collect()), key=repr)
    assert got == expected(rows)
