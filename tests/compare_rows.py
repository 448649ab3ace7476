"""Helpers to compare Spark rows with DuckDB rows."""

import math
import os


def views(con, sf_dir):
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")


def _cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    return str(round(float(x), 9) + 0.0) if isinstance(x, float) else str(x)


def compare(frame, result) -> str:
    """"same (n rows)", or the first difference."""
    names = [c[0] for c in result.description]
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} {sorted(names)}"
    cols = sorted(names)
    got = sorted([tuple(_cell(r[c]) for c in cols) for r in frame.collect()], key=repr)
    want = sorted([tuple(_cell(r[names.index(c)]) for c in cols) for r in result.fetchall()], key=repr)
    if got == want:
        return f"same ({len(got)} rows)"
    bad = next(((g, w) for g, w in zip(got, want, strict=False) if g != w), None)
    return f"rows {len(got)} {len(want)}; first {cols} {bad}; differ {sum(g != w for g, w in zip(got, want, strict=False))}"
