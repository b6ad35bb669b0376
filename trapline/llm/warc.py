"""Deterministic sharded WARC writer and reader.

Rows are range-partitioned and sorted by ``page_id``; the ranges' bounds follow from
the rows alone (ids picked by their hash, and shares of the digests of an id that has
more rows than a task should), so they don't change between runs. Each task writes its run
as gzip members, one per record, and starts a new file once a file's compressed
size passes ``roll_bytes``. Headers, record ids, block and payload digests come
from the row alone, so equal input gives equal bytes. A file is written under a
temporary name of the task attempt and renamed when whole; a task that is run
again puts the same file in the same place. The files' names, sizes and digests
go to a manifest, and the reader takes only what a finished manifest lists.

Of records with equal payloads of at least ``MIN_REVISIT_BYTES`` bytes, the one
with the largest page_id is a response with the payload, the others are
revisits without it. That is settled on digests; a note for each revisit sorts
in before its page, so payloads are shuffled once.

Defined cases: a null payload is empty; a null page_id counts as smallest and
reads back as null; rows that repeat the largest page_id are all responses; an
empty table gives a manifest without files; control characters in a URL are
percent-encoded; only ``page_id``, ``url`` and ``html`` are read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values of the record format
MIN_REVISIT_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"

ROLL_BYTES = 32 << 20
#: ids looked at for a range's bounds
SAMPLED = 16
_READ_BYTES = 1 << 20
_MANIFEST = "file string, records long, bytes long, sha1 string"
_RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a URI, as Hadoop or as Python writes it, and the path on it."""
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri) if ":" in uri else f"file://{uri}")


def record_id(page: str, digest: str, repeat: int = 0) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(f'{page} {digest} {repeat}'.encode()).digest()[:16], version=5)}>"


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    headers = [*headers, ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers).encode() + b"\r\n" + block + END


def _member(data: bytes) -> bytes:
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gz.compress(data) + gz.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, repeat: int) -> bytes:
    """A response record, or with ``refers_to`` a revisit; ``size`` and ``digest`` are the full payload's."""
    revisit = refers_to is not None
    page = "-" if page_id is None else str(page_id)
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page, digest, repeat)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", quote(url or "", safe="%:/?#[]@!$&'()*+,;=~")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Page-ID", page),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(str(refers_to), digest)), ("WARC-Refers-To-Page-ID", str(refers_to))]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    return _record(headers, http if revisit else http + payload)


class _Writer:
    """Files of one task: temporary while open, renamed when whole."""

    def __init__(self, root: str, part: int, roll_bytes: int):
        self.fs, self.path = store(root)
        self.part, self.roll, self.seq, self.out, self.done = part, roll_bytes, 0, None, []
        self.temp = f"{self.path}/_temporary/{uuid.uuid4().hex}"

    def add(self, record: bytes) -> None:
        if self.out is None:
            self.name = f"part-{self.part:05d}-{self.seq:05d}.warc.gz"
            self.fs.create_dir(self.temp, recursive=True)
            self.out, self.sha, self.bytes, self.records = self.fs.open_output_stream(f"{self.temp}/{self.name}", compression=None), hashlib.sha1(), 0, 0
            info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(self.name, "")), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")]
            self._put(_record(info, b"format: WARC File Format 1.1\r\n"))
        self._put(record)
        self.records += 1
        if self.bytes >= self.roll:
            self.close()

    def _put(self, record: bytes) -> None:
        data = _member(record)
        self.out.write(data)
        self.sha.update(data)
        self.bytes += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.create_dir(f"{self.path}/data", recursive=True)
            place = f"{self.path}/data/{self.name}"
            if self.fs.get_file_info(place).type != pyarrow.fs.FileType.NotFound:
                self.fs.delete_file(place)  # of an earlier attempt; not every file system moves onto a file
            self.fs.move(f"{self.temp}/{self.name}", place)
            self.done.append({"file": f"data/{self.name}", "records": self.records, "bytes": self.bytes, "sha1": self.sha.hexdigest()})
            self.out, self.seq = None, self.seq + 1


def _write_batches(batches: Iterator[pa.RecordBatch], root: str, roll_bytes: int) -> Iterator[pa.RecordBatch]:
    writer = _Writer(root, TaskContext.get().partitionId(), roll_bytes)
    last, repeat, keeper = None, 0, None
    for batch in batches:
        for i in range(batch.num_rows):  # a record at a time: a batch may hold large payloads
            row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
            key = row["page_id"], row["digest"]
            if key != last:
                last, repeat, keeper = key, 0, None
            if row["tag"] == 0:
                keeper = row["refers_to"]
                continue
            writer.add(page_record(row["page_id"], row["url"], row["payload"], row["size"], row["digest"], keeper, repeat))
            repeat += 1
    writer.close()
    if writer.done:
        yield pa.RecordBatch.from_pylist(writer.done)


def tagged(pages: DataFrame) -> DataFrame:
    """All pages, and before those of them that are revisits a row without payload that names the keeper."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("size"), F.sha1("payload").alias("digest"))
    narrow = rows.where(F.col("size") >= MIN_REVISIT_BYTES).select("page_id", "digest", F.sha2("payload", 256).alias("sha256"))
    again = (
        narrow.groupBy("sha256")
        .agg(F.count(F.lit(1)).alias("copies"), F.max("page_id").alias("keeper"))
        .where((F.col("copies") > 1) & F.col("keeper").isNotNull())
    )
    revisits = narrow.join(again, "sha256").where(~F.col("page_id").eqNullSafe(F.col("keeper"))).select("page_id", "digest", F.col("keeper").alias("refers_to")).distinct()
    empty = [F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), F.lit(None).cast("long").alias("size")]
    notes = revisits.select("page_id", "digest", *empty, "refers_to", F.lit(0).alias("tag"))
    return notes.unionByName(rows.withColumns({"refers_to": F.lit(None).cast("long"), "tag": F.lit(1)}))


def bounds(pages: DataFrame, parts: int) -> list[tuple[bool, int, str]]:
    """Range bounds ``(id is there, id, digest from)``: the same ones for the same rows, however they are dealt out.

    About ``SAMPLED`` ids a part reach the driver, and the ids of more rows than a part's share.
    """
    ids = pages.groupBy(F.col("page_id").cast("long").alias("page_id")).agg(F.count(F.lit(1)).alias("n"))
    total, distinct = ids.agg(F.sum("n"), F.count(F.lit(1))).first()
    share, step = max(1, (total or 0) // parts), max(1, (distinct or 0) // (SAMPLED * parts))
    picked = ids.where(F.pmod(F.xxhash64("page_id"), F.lit(step)) == 0).select("page_id").collect()
    places = sorted((r["page_id"] is not None, r["page_id"] or 0, "") for r in picked)
    cuts = {places[len(places) * k // parts] for k in range(1, parts)} if places else set()
    for r in ids.where(F.col("n") > 2 * share).collect():
        own, fan = (r["page_id"] is not None, r["page_id"] or 0), -(-r["n"] // share)
        cuts |= {(*own, f"{(k << 32) // fan:08x}") for k in range(fan)} | {(*own, "g")}
    return sorted(cuts)


def write(pages: DataFrame, root: str, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write an archive below ``root``; returns its manifest."""
    spark = pages.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = bounds(pages, parts)

    @F.pandas_udf("int")
    def part(page_id: pd.Series, here: pd.Series, digest: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(cuts, key) for key in zip(here.tolist(), page_id.tolist(), digest.tolist())], dtype="int32")

    where = part(F.coalesce("page_id", F.lit(0).cast("long")), F.col("page_id").isNotNull(), "digest")
    ranged = tagged(pages).repartitionById(len(cuts) + 1, where).sortWithinPartitions("page_id", "digest", "tag", "url")
    manifest = ranged.mapInArrow(lambda it: _write_batches(it, root, roll_bytes), _MANIFEST)
    manifest.write.mode("overwrite").parquet(f"{root}/manifest")  # listed only when every task is done
    return spark.read.schema(_MANIFEST).parquet(f"{root}/manifest")


def _members(stream: pa.NativeFile) -> Iterator[bytes]:
    data = b""
    while True:
        data = data or stream.read(_READ_BYTES)
        if not data:
            return
        gz, out = zlib.decompressobj(31), []
        while not gz.eof:
            if not data:
                data = stream.read(_READ_BYTES)
                if not data:
                    raise ValueError("the archive ends within a record")
            out.append(gz.decompress(data))
            data = gz.unused_data
        yield b"".join(out)


def _fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])


def parse(record: bytes) -> dict | None:
    """A page's row of a record (None: no page record); its digests are checked."""
    head, _, rest = record.partition(END)
    fields = _fields(head)
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != END or fields["WARC-Block-Digest"] != f"sha1:{hashlib.sha1(block).hexdigest()}":
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    if fields["WARC-Type"] not in ("response", "revisit"):
        return None
    http, _, payload = block.partition(END)
    size, digest = int(_fields(http)["Content-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
    whole = fields["WARC-Type"] == "response"
    if whole and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged payload {fields['WARC-Record-ID']}")
    number = lambda k: int(fields[k]) if fields.get(k, "-") != "-" else None
    return {
        "page_id": number("WARC-Page-ID"), "url": fields["WARC-Target-URI"], "payload_bytes": size, "payload_digest": digest,
        "record_type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To-Page-ID"), "payload": payload if whole else None,
    }


def _read_batches(batches: Iterator[pa.RecordBatch], root: str, columns: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    fs, path = store(root)
    for batch in batches:
        for name, count in zip(batch.column("file").to_pylist(), batch.column("records").to_pylist()):
            rows, held, seen = [], 0, 0
            with fs.open_input_stream(f"{path}/{name}", compression=None) as stream:
                for record in _members(stream):
                    if (row := parse(record)) is None:
                        continue
                    seen += 1
                    rows.append({c: row[c] for c in columns})
                    held += len(record) if "payload" in columns else 200
                    if held >= 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
            if seen != count:
                raise ValueError(f"{name}: {seen} records, {count} in the manifest")
            yield pa.RecordBatch.from_pylist(rows, schema)


def read(spark: SparkSession, root: str, columns: list[str] | None = None) -> DataFrame:
    """The archive's page records; ``columns`` of page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload."""
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    every = dict(x.strip().split(" ") for x in _RECORDS.split(","))
    columns = columns or list(every)
    files = spark.read.schema(_MANIFEST).parquet(f"{root}/manifest").select("file", "records")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = pa.schema([(c, kinds[every[c]]) for c in columns])
    spread = files.repartition(parts, "file")
    return spread.mapInArrow(lambda it: _read_batches(it, root, columns, schema), ", ".join(f"{c} {every[c]}" for c in columns))
