"""Runs a query and its SQL over the same tables and compares rows without order."""

import duckdb
import pandas as pd


def frames(spark, query, sql, sf_dir, tables=("documents", "pages", "embeddings", "labels")):
    got = query(spark, sf_dir).toPandas()
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    want = con.execute(sql).df()
    return got, want


def same(got: pd.DataFrame, want: pd.DataFrame):
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    a = got[cols].astype(object).where(got[cols].notna(), None).map(str).sort_values(cols).reset_index(drop=True)
    b = want[cols].astype(object).where(want[cols].notna(), None).map(str).sort_values(cols).reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b)
