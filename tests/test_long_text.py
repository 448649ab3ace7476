import gzip

import pytest

from tessera.operators.validate import COLUMNS
from tessera.sources import long_text
from tessera.sources.cohort_view import long_table

ROW = ["m1", "s1", "3", "7", "1", "0.5", "2", "g1", "c1", "1", "1", "1"]


def put(path, rows=(ROW,), head=COLUMNS, before=("##tumor_id=t1",), gz=False):
    text = "\n".join([*before, "# a comment", "\t".join(head), *("\t".join(r) for r in rows), ""])
    path.write_bytes(gzip.compress(text.encode()) if gz else text.encode())
    return str(path)


@pytest.mark.parametrize("gz", [False, True])
def test_reads_plain_and_gzip(spark, tmp_path, gz):
    at = put(tmp_path / ("x.tsv.gz" if gz else "x.tsv"), head=[*COLUMNS, "more"], rows=[[*ROW, "z"]], gz=gz)
    row = long_text.load(spark, at).first()
    assert (row.tumor_id, row.alt_count, row.purity, row.allele_a_cn) == ("t1", 3, 0.5, 1)
    assert "more" not in row.asDict()


def test_default_id_and_metadata(spark, tmp_path):
    at = put(tmp_path / "Case7.tsv", before=["##note=a=b"])
    row = long_text.read_metadata(spark, at).first()
    assert row.tumor_id == "Case7" and row.metadata["note"] == "a=b" and row.metadata["missing_value"] == "."


@pytest.mark.parametrize(
    ("change", "says"),
    [({"before": ["##=x"]}, "without key"), ({"before": ["##a=1", "##a=2"]}, "repeated metadata"), ({"before": ["##missing_value=NA"]}, "missing_value"), ({"before": ["##schema=other"]}, "schema"), ({"before": ["##tumor_id=a/b"]}, "file name"),
     ({"head": COLUMNS[:-1], "rows": [ROW[:-1]]}, "missing columns"), ({"head": [*COLUMNS, "purity"], "rows": [[*ROW, "1"]]}, "repeated column"), ({"rows": [ROW[:-1]]}, "number of cells"), ({"rows": [["", *ROW[1:]]]}, "empty cell"),
     ({"rows": [ROW, COLUMNS]}, "second header"), ({"rows": [[*ROW[:5], "2", *ROW[6:]]]}, "purity"), ({"rows": [ROW, ROW]}, "repeated state"), ({"rows": [[*ROW[:9], "0.5", "1", "1"]]}, "sum to 1")],
)
def test_malformed_files(spark, tmp_path, change, says):
    with pytest.raises(ValueError, match=says):
        long_text.load(spark, put(tmp_path / "x.tsv", **change))


def test_round_trip(spark, tmp_path):
    long = long_table(spark, "/root/testdata/sf0.001").filter("tumor_id IN ('Brand#1', 'Brand#2')")
    long_text.write(long, str(tmp_path / "out"))
    back = long_text.load(spark, str(tmp_path / "out" / "*" / "*.txt"))
    cast = [f"cast({c} AS string) AS {c}" for c in ["tumor_id", *COLUMNS]]
    assert sorted(map(tuple, back.selectExpr(*cast).collect()), key=repr) == sorted(map(tuple, long.selectExpr(*cast).collect()), key=repr)
