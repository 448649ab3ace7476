import math

import numpy as np
import pyarrow as pa

from tessera.llm import hard_negatives as H
from tessera.llm import queries
from tests.llm.oracle import frames, same


def slow(rows, every=100, positives=5, negatives=10):
    """By the definition, in Python integers."""
    own = []
    for i, (vec_id, e, label) in enumerate(rows):
        if label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        own.append((i, vec_id, (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in e]))
    first = lambda found, k: sorted(found, key=lambda f: (-f[0], math.inf if f[1] is None else f[1], f[2]))[:k]
    cut = lambda s: max(-(2**63 - 1), min(2**63 - 1, s))
    out = []
    for i, a, label, v in own:
        if a is None or a % every:
            continue
        scores = [(sum(x * y for x, y in zip(v, w)), b, j, other) for j, b, other, w in own if j != i]
        for p, b, _, _ in first([s for s in scores if s[3] == label], positives):
            p = cut(p)
            for rank, (n, c, _, _) in enumerate(first([s for s in scores if s[3] != label and 30 * p <= 100 * s[0] <= 90 * p], negatives)):
                out.append((a, b, rank + 1, c, p, cut(n)))
    return sorted(out, key=repr)


def run(spark, rows, **options):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, row int, list string")
    return sorted((tuple(r)[:6] for r in H.mined(frame, **options).collect()), key=repr)


def odd_rows():
    rng = np.random.default_rng(3)
    rows = [(i, (rng.standard_normal(6) / 3).tolist(), int(rng.integers(0, 3))) for i in range(400)]
    copy, near = rows[100][1], (np.array(rows[200][1]) * 0.7).tolist()
    rows += [(1000 + i, copy, i % 3) for i in range(60)] + [(2000 + i, near, i % 3) for i in range(40)]  # many ties
    rows += [(100, copy, 1), (100, copy, 1), (300, rows[300][1], 2)]  # repeated ids, also of anchors
    rows += [(None, copy, 1), (None, near, 2), (3000, None, 1), (3100, [], 1), (3200, copy[:3], 1), (3300, copy + [0.5], 2), (3400, copy, None)]
    rows += [(3500, [math.nan] * 6, 1), (3600, [math.inf] * 6, 1), (3700, [None] * 6, 1), (3800, [0.0] * 6, 1), (3900, [-1.0] * 6, 9), (4001, [-1.0] * 6, -5)]
    return rows


def test_odd_rows_against_brute_force(spark, monkeypatch):
    rows = odd_rows()
    want = slow(rows)
    assert len(want) > 200
    assert run(spark, rows) == want
    for name, v in (("STORED", 7), ("VISITORS", 2)):
        monkeypatch.setattr(H, name, v)
    assert run(spark, rows, list_rows=12, first_wave=1) == want  # many lists, chunks and waves
    assert run(spark, rows, list_rows=40, fit_rows=5, every=50, positives=2, negatives=3) == slow(rows, 50, 2, 3)


def test_scores_beyond_doubles(spark):
    rng = np.random.default_rng(4)
    rows = [(i * 50, (rng.standard_normal(4) * 10.0 ** rng.integers(0, 9)).astype(np.float32).tolist(), int(rng.integers(0, 2))) for i in range(60)]
    rows += [(100, [3.0e38] * 4, 0), (7, [3.0e38] * 4, 1), (9, [-3.0e38] * 4, 1)]
    assert run(spark, rows, list_rows=10) == slow(rows)


def test_empty_and_all_unusable(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, None, 1), (100, [math.nan], 2)]) == []
    assert run(spark, [(0, [1.0], 1)]) == [] and run(spark, [(0, [1.0], 1), (1, [1.0], 1)]) == []


def test_lists_are_passed_by_only_where_bounds_allow():
    rng = np.random.default_rng(5)
    x = np.floor(rng.standard_normal((300, 5)) * 50)
    c = x[:9]
    own = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
    index = H.Index(c, np.array([np.linalg.norm(x[own == k] - c[k], axis=1).max() for k in range(9)]), np.bincount(own, minlength=9), np.ones((9, H.LABEL_BITS), dtype=bool))
    high, low = index.bounds(x)
    scores = H.products(x, x)
    for k in range(9):
        assert (scores[:, own == k].max(1) <= high[:, k]).all() and (scores[:, own == k].min(1) >= low[:, k]).all()
    assert not (high >= scores.max(1)[:, None]).all()  # some lists can be passed by


def test_matrix_of_ragged_rows():
    got = H.matrix(pa.array([[1.0, 2.0], [], [3.0]], pa.list_(pa.float64())), 3)
    assert got.tolist() == [[1, 2, 0], [0, 0, 0], [3, 0, 0]]
    assert H.matrix(pa.array([], pa.list_(pa.float64()))).shape == (0, 0)


def test_query_matches_sql(spark):
    same(*frames(spark, queries.QUERIES["op11_hard_negatives"], queries.ORACLE_SQL["op11_hard_negatives"], "/root/testdata/sf0.1"))
