"""Content-addressed WARC archive.

Payload bytes are stored once by their SHA-256, which is verified when they are read; exact record headers are stored apart.
Records are rebuilt by joining the two on the digest. A record whose payload another record holds is a revisit record.

The payload table is bucketed by digest: payloads are shuffled once, when they are written, and the join that rebuilds records
moves headers only. Each digest has one record that carries its bytes, so that join never meets a hot key; revisits join the
digests and lengths computed from the stored bytes.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import new_path

#: Record date: the time of a capture isn't in the pages table, so archives of equal pages are equal.
DATE = "1970-01-01T00:00:00Z"
#: Fixed value: the profile of revisits of identical payloads in WARC 1.1.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = "urn:x-page:"
#: Most buckets that Spark's bucketed tables may have by default.
MOST_BUCKETS = 100_000
#: Copies of one row that are numbered from one array.
NUMBERED = 4096
#: Bytes of records, about, in one row of ``warc_bytes``.
PART_BYTES = 8 << 20

_KEPT = "page_id long, copy long, sha256 string, kind string, refers_to long, n_bytes long, carrier boolean, header binary"
_INDEX = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def header_block(record: str, page_id: int | None, copy: int, url: str | None, sha1: str, sha256: str, n_bytes: int, refers_to: int | None) -> bytes:
    """The exact bytes of a record before its payload: WARC fields, and the HTTP head that starts the block of its type.
    ``copy`` tells repeated rows apart."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {record}",
        f"WARC-Record-ID: <{NAMESPACE}{'null' if page_id is None else page_id}:{sha256[:16]}:{copy}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=chr(37) + ':/?#[]@!$&()*+,;=~' + chr(39))}",
        f"WARC-Payload-Digest: sha1:{sha1}",
        f"X-Payload-Digest: sha256:{sha256}",
        f"X-Payload-Length: {n_bytes}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + (n_bytes if record == 'response' else 0)}",
    ]
    if record == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{NAMESPACE}{'null' if refers_to is None else refers_to}:{sha256[:16]}:0>"]
    return ("\r\n".join(lines) + "\r\n\r\n" + http).encode()


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Fields (lower-case names) and the HTTP body of one record; raises ValueError if it is not a whole WARC record."""
    head, mark, rest = record.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not mark or not first.startswith("WARC/1."):
        raise ValueError("no WARC header")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("block and Content-Length differ")
    status, mark, body = rest[:size].partition(b"\r\n\r\n")
    if not mark or not status.startswith(b"HTTP/1."):
        raise ValueError("no HTTP head")
    return fields, body


def _keyed(pages: DataFrame) -> DataFrame:
    """page_id, url, payload and its digests, by JVM functions."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload")).select(
        "*", F.sha2("payload", 256).alias("sha256"), F.sha1("payload").alias("sha1"), F.length("payload").cast("long").alias("n_bytes")
    )


def _bucketed(spark: SparkSession, path: str, buckets: int) -> DataFrame:
    """The payload table at ``path``; its layout is declared for the time of the lookup only."""
    name = f"tessera_payloads_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} (sha256 STRING, payload BINARY) USING parquet CLUSTERED BY (sha256) INTO {buckets} BUCKETS LOCATION '{path}'")
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files are external: only the name goes
    return found


def write_archive(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Writes ``path``/headers, ``path``/payloads and ``path``/layout from (page_id, url, html).

    Of the records with equal payloads of at least ``least_bytes`` bytes, that with the largest page_id is the response
    (null ids count as the smallest) and the others revisit it; of rows with that id, the one with the largest url, and of
    equal rows, one. Smaller payloads are all responses. Null html is the empty payload; every row gives one record.
    Digests alone are compared, and equal payloads are combined before they are shuffled, so of copies of one page,
    however many, a task sends one.
    """
    spark, keyed = pages.sparkSession, _keyed(pages)
    buckets = min(MOST_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    name = f"tessera_payloads_{uuid.uuid4().hex}"
    once = keyed.groupBy("sha256").agg(F.first("payload").alias("payload"))
    once.write.format("parquet").option("compression", "zstd").bucketBy(buckets, "sha256").option("path", f"{path}/payloads").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")
    spark.range(1).select(F.lit(buckets).alias("buckets"), F.lit(int(least_bytes)).cast("long").alias("least_bytes")).coalesce(1).write.parquet(f"{path}/layout")

    light = keyed.groupBy("sha256", "sha1", "n_bytes", "page_id", "url").agg(F.count("*").alias("copies"))
    holder = light.groupBy("sha256").agg(F.max(F.struct("page_id", "url")).alias("h")).select("sha256", F.col("h.page_id").alias("holder"), F.col("h.url").alias("holder_url"))
    holds = F.col("page_id").eqNullSafe(F.col("holder")) & F.col("url").eqNullSafe(F.col("holder_url"))
    # equal rows, and rows of one id that differ in their url, are numbered; the holder's record has number 0
    numbered = light.join(holder, "sha256").select("*", holds.alias("holds"), F.explode(F.expr(f"sequence(0L, copies - 1, {NUMBERED}L)")).alias("low"))
    numbered = numbered.select("*", F.explode(F.expr(f"sequence(low, least(low + {NUMBERED - 1}, copies - 1))")).alias("nth"))
    copy = F.when(F.col("holds"), F.col("nth")).otherwise(F.xxhash64("url", "sha256").bitwiseAND(F.lit(0x7FFFFFFFFFFF)) * 1024 + F.col("nth") + 1)
    carrier = F.col("holds") & (F.col("nth") == 0)
    is_revisit = (F.col("n_bytes") >= least_bytes) & ~carrier
    rows = numbered.select(
        "page_id", "url", "sha256", "sha1", "n_bytes", copy.cast("long").alias("copy"), F.when(is_revisit, "revisit").otherwise("response").alias("kind"),
        F.when(is_revisit, F.col("holder")).alias("refers_to"), carrier.alias("carrier"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads = [
                header_block(r["kind"], r["page_id"], r["copy"], r["url"], base64.b32encode(bytes.fromhex(r["sha1"])).decode(), r["sha256"], r["n_bytes"], r["refers_to"])
                for r in b.to_pylist()
            ]
            names = ["page_id", "copy", "sha256", "kind", "refers_to", "n_bytes", "carrier"]
            yield pa.record_batch([*(b.column(c) for c in names), pa.array(heads, pa.binary())], names=[*names, "header"])

    rows.mapInArrow(run, _KEPT).write.option("compression", "zstd").parquet(f"{path}/headers")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(sha256, payload) of the archive at ``path``, bucketed by digest."""
    layout = spark.read.parquet(f"{path}/layout").first()
    return _bucketed(spark, f"{path}/payloads", layout.buckets)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """One row a record; ``carrier`` marks the one record of each digest that every payload is joined to."""
    return spark.read.schema(_KEPT).parquet(f"{path}/headers")


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for name, p in zip(b.column("sha256").to_pylist(), b.column("payload"), strict=True):
            if hashlib.sha256(p.as_buffer()).hexdigest() != name:
                raise ValueError(f"stored payload does not have digest {name}")
        yield b


_FULL = f"{_KEPT}, payload binary"


def _with_payload(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Headers with verified payloads: carriers, which meet each payload once; other responses, of payloads below the least
    length, by a join that splits skewed keys; and the headers of revisits, which have none."""
    headers, payloads = read_headers(spark, path), read_payloads(spark, path)
    least = spark.read.parquet(f"{path}/layout").first().least_bytes
    carriers = headers.filter("carrier").join(payloads, "sha256").select(*headers.columns, "payload").mapInArrow(_verified, _FULL)
    if not least:
        return carriers, carriers.filter("false"), headers.filter("NOT carrier")
    small = spark.read.schema("sha256 string, payload binary").parquet(f"{path}/payloads").filter(F.length("payload") < least)
    others = headers.filter("NOT carrier AND kind = 'response'").join(small, "sha256").select(*headers.columns, "payload").mapInArrow(_verified, _FULL)
    return carriers, others, headers.filter("NOT carrier AND kind = 'revisit'")


def records(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, copy, record): the original record bytes, rebuilt by joining headers and payloads."""
    carriers, others, revisits = _with_payload(spark, path)
    end = F.lit(b"\r\n\r\n")
    full = carriers.union(others).select("page_id", "copy", F.concat("header", "payload", end).alias("record"))
    return full.union(revisits.select("page_id", "copy", F.concat("header", end).alias("record")))


def payload_of(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(page_id, copy, payload): the full payload of the records whose page_id is in ``wanted``, of revisits too."""
    ids = wanted.select(F.col("page_id").cast("long")).distinct()
    asked = read_headers(spark, path).join(ids, "page_id", "left_semi").select("page_id", "copy", "sha256")
    payloads = spark.read.schema("sha256 string, payload binary").parquet(f"{path}/payloads")
    return asked.join(payloads, "sha256").select("page_id", "copy", "payload")


def warc_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(part, seq, warc): the archive as bytes of .warc files, whole records of about ``PART_BYTES`` in a row; the rows of a part
    in the order of seq, or any rows, make a valid file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for record in b.column(0):
                held.append(record.as_py())
                size += len(held[-1])
                if size >= PART_BYTES:
                    yield pa.record_batch([pa.array([b"".join(held)], pa.binary())], names=["warc"])
                    held, size = [], 0
        if held:
            yield pa.record_batch([pa.array([b"".join(held)], pa.binary())], names=["warc"])

    packed = records(spark, path).select("record").mapInArrow(run, "warc binary")
    place = F.monotonically_increasing_id()
    return packed.select(F.shiftright(place, 33).cast("int").alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("seq"), "warc")


def _checked(header: bytes, payload: bytes | None, kind: str, sha1: str, n_bytes: int) -> tuple:
    """The index row of one record, parsed from its rebuilt bytes and checked against its payload's digest and length."""
    fields, body = parse_record(header + (payload or b"") + b"\r\n\r\n")
    if fields["warc-type"] != kind or fields["warc-payload-digest"] != f"sha1:{sha1}" or int(fields["x-payload-length"]) != n_bytes or body != (payload or b""):
        raise ValueError(f"record {fields['warc-record-id']} is not what was written")
    own, to = (x.removeprefix(f"<{NAMESPACE}").partition(":")[0] for x in (fields["warc-record-id"], fields.get("warc-refers-to", "null")))
    return None if own == "null" else int(own), n_bytes, sha1, kind, None if to == "null" else int(to)


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def index(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) parsed from the rebuilt records, each checked against the
    digests and the length of the stored payload. A revisit of a record with a null page_id has a null refers_to."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for header, full, kind in zip(b.column("header"), b.column("payload"), b.column("kind").to_pylist(), strict=True):
                payload = full.as_py()
                rows.append(_checked(header.as_py(), payload, kind, base32_sha1(payload), len(payload)))
            yield _index_batch(rows)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _verified(batches):
            payloads = b.column("payload").to_pylist()
            yield pa.record_batch([b.column("sha256"), pa.array(map(base32_sha1, payloads), pa.string()), pa.array(map(len, payloads), pa.int64())], names=["sha256", "sha1", "n"])

    def revisit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = (b.column(c).to_pylist() for c in ("header", "kind", "sha1", "n"))
            yield _index_batch([_checked(header, None, kind, sha1, n) for header, kind, sha1, n in zip(*columns, strict=True)])

    carriers, others, revisits = _with_payload(spark, path)
    own = spark.read.schema("sha256 string, payload binary").parquet(f"{path}/payloads").mapInArrow(digest, "sha256 string, sha1 string, n long")
    again = revisits.select("sha256", "header", "kind").join(own, "sha256").select("header", "kind", "sha1", "n").mapInArrow(revisit, _INDEX)
    return carriers.union(others).mapInArrow(read, _INDEX).union(again)


def archived(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes an archive of ``pages`` in the shared folder and reads its index back.

    Null html is the empty payload, null ids and urls stay null; repeated rows come out as often as they come in, and ties are
    decided as ``write_archive`` says; an empty table gives no rows; other columns, whatever their names, are not read. A very
    long page costs memory in proportion to its own length.
    """
    path = new_path(pages.sparkSession, "warc")
    write_archive(pages, path, least_bytes)
    return index(pages.sparkSession, path)


#: The index in DuckDB but for the digest, which it gives as bytes only; base 32 is spelled out from 5-bit groups.
SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS hex FROM p),
m AS (SELECT hex, max(page_id) AS holder FROM d GROUP BY hex)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((
      ((instr('0123456789abcdef', substr(hex, CAST(i * 5 // 4 AS INT) + 1, 1)) - 1) * 16
       + CASE WHEN i * 5 // 4 + 2 <= 40 THEN instr('0123456789abcdef', substr(hex, CAST(i * 5 // 4 AS INT) + 2, 1)) - 1 ELSE 0 END)
      >> CAST(3 - i * 5 % 4 AS INT)) & 31 AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> holder THEN holder END AS refers_to
FROM d JOIN m USING (hex)
"""
