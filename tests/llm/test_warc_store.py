import base64
import hashlib

import pytest

from tessera.llm import warc_store
from tessera.llm.common import new_path
from tessera.llm.queries import op6_warc_archive
from tests.llm.oracle import frames, same

SF = "/root/testdata/sf0.01"


def test_query_matches_sql(spark):
    same(*frames(spark, op6_warc_archive, warc_store.SQL, SF))


def rows():
    return [(1, "http://a/é b", "x" * 50), (9, "http://b", "x" * 50), (4, None, "x" * 50), (2, "c", None), (3, "d", ""), (5, "e", "only"), (5, "e", "only"), (5, "f", "only"), (None, "g", "null id"), (None, None, "é")]


def slow(rows, least=0):
    out = []
    by = {}
    for i, (pid, url, h) in enumerate(rows):
        by.setdefault(h or "", []).append(((pid is not None, pid, url or "", -i), i))
    for h, own in by.items():
        best = max(own, key=lambda x: (x[0][0], x[0][1] or 0, x[0][2], x[0][3]))
        for _, i in own:
            b = h.encode()
            revisit = len(b) >= least and i != best[1]
            out.append((rows[i][0], len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", rows[best[1]][0] if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 20])
def test_index_against_brute_force(spark, least):
    pages = spark.createDataFrame(rows(), "page_id long, url string, html string")
    got = [tuple(r) for r in warc_store.archived(pages, least).collect()]
    assert sorted(got, key=repr) == slow(rows(), least)


def test_payloads_are_stored_once_and_records_parse(spark):
    pages = spark.createDataFrame([(*r, 7) for r in rows()], "page_id long, url string, html string, payload int")
    path = new_path(spark, "warc")
    warc_store.write_archive(pages, path)
    assert warc_store.read_payloads(spark, path).count() == len({r[2] or "" for r in rows()})
    ids = set()
    for r in warc_store.records(spark, path).collect():
        fields, block = warc_store.parse_record(bytes(r.record))
        ids.add(fields["warc-record-id"])
        assert len(block) == (0 if fields["warc-type"] == "revisit" else int(fields["x-payload-length"]))
        assert (fields["warc-type"] == "revisit") == ("warc-refers-to" in fields)
    assert len(ids) == len(rows())
    whole = b"".join(bytes(r.warc) for r in warc_store.warc_bytes(spark, path).orderBy("part", "seq").collect())
    assert sum(len(r.record) for r in warc_store.records(spark, path).collect()) == len(whole) and whole.count(b"WARC/1.1\r\n") == len(ids)
    wanted = spark.createDataFrame([(1,), (5,)], "page_id long")
    got = warc_store.payload_of(spark, path, wanted).collect()
    assert sorted((r.page_id, bytes(r.payload)) for r in got) == [(1, b"x" * 50), (5, b"only"), (5, b"only"), (5, b"only")]
    assert not spark.catalog.listTables()


def test_many_copies_of_one_row_and_long_pages(spark):
    rows = [(1, "u", "copy")] * 9000 + [(2, "v", "y" * 3_000_000), (3, "v", "y" * 3_000_000)]
    got = warc_store.archived(spark.createDataFrame(rows, "page_id long, url string, html string")).groupBy("page_id", "record_type", "refers_to", "payload_bytes").count().collect()
    want = [(1, "response", None, 4, 1), (1, "revisit", 1, 4, 8999), (2, "revisit", 3, 3_000_000, 1), (3, "response", None, 3_000_000, 1)]
    assert sorted(map(tuple, got)) == want


def test_damage_is_noticed(spark):
    path = new_path(spark, "warc")
    warc_store.write_archive(spark.createDataFrame([(1, "u", "abc")], "page_id long, url string, html string"), path)
    digest = hashlib.sha256(b"abc").hexdigest()
    name, wrong = f"damage_{abs(hash(path))}", spark.createDataFrame([(digest, bytearray(b"abd"))], "sha256 string, payload binary")
    wrong.write.mode("overwrite").bucketBy(4, "sha256").option("path", f"{path}/payloads").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")
    with pytest.raises(Exception, match="does not have digest"):
        warc_store.index(spark, path).collect()
    with pytest.raises(ValueError):
        warc_store.parse_record(b"WARC/1.1\r\nContent-Length: 3\r\n\r\nab\r\n\r\n")
    with pytest.raises(ValueError):
        warc_store.parse_record(b"WARC/1.1\r\nContent-Length: 2\r\n\r\nab\r\n\r\n")


def test_empty_table(spark):
    assert warc_store.archived(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
