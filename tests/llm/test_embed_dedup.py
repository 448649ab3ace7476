import numpy as np
import pytest

from tessera.llm import embed_dedup


def slow(rows, cosine=0.93):
    """(vec_id, n_links, component_id, kept) for each row."""
    ok = [i for i, (v, e, l) in enumerate(rows) if v is not None and l is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    links = [0] * len(rows)
    groups = {}
    for i in ok:
        groups.setdefault((rows[i][2], len(rows[i][1])), []).append(i)
    for own in groups.values():
        x = np.array([rows[i][1] for i in own], dtype=np.float32).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= cosine, 1))):
            i, j = own[a], own[b]
            links[i] += 1
            links[j] += 1
            up[find(i)] = find(j)
    least = {}
    for i, (v, _, _) in enumerate(rows):
        if v is not None:
            least[find(i)] = min(v, least.get(find(i), v))
    return sorted(((v, links[i], least.get(find(i)) if v is not None else None, v is None or least[find(i)] == v) for i, (v, _, _) in enumerate(rows)), key=repr)


def test_odd_rows_against_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = []
    for g in range(30):
        base = rng.standard_normal(8)
        for _ in range(rng.integers(1, 6)):
            rows.append((len(rows), (base + 0.05 * rng.standard_normal(8)).tolist(), int(g % 2)))
    copy = rng.standard_normal(8).tolist()
    rows += [(200 + i, copy, 0) for i in range(40)] + [(300 + i, copy, 1) for i in range(3)] + [(200, copy, 0)]
    rows += [(400, None, 0), (401, [], 0), (402, [0.0] * 8, 0), (403, [1.0] * 7 + [None], 0), (404, [1.0] * 7 + [float("nan")], 0), (405, [1.0] * 7 + [float("inf")], 0)]
    rows += [(406, copy, None), (None, copy, 0), (407, copy[:4], 0), (408, copy[:4], 0), (409, [-0.0, 1.0], 0), (410, [0.0, 1.0], 0), (411, [3.0], 0), (412, [5.0], 0), (413, [-5.0], 0)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, rep int")
    got = sorted((tuple(r) for r in embed_dedup.linked(frame).collect()), key=repr)
    assert got == slow(rows)


def hard_rows(n=4000, dim=32):
    """One large group of equal vectors, one of near ones, pairs at all similarities about the threshold, and the rest."""
    rng = np.random.default_rng(11)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    hot, near = unit(rng.standard_normal(dim)), unit(rng.standard_normal(dim))
    base = unit(rng.standard_normal((n // 4, dim)))
    side = rng.standard_normal(base.shape)
    side = unit(side - (side * base).sum(1, keepdims=True) * base)
    cos = rng.uniform(0.9, 1, (len(base), 1))
    every = np.concatenate((np.repeat(hot[None], n // 5, 0), unit(near + 0.03 * rng.standard_normal((n // 5, dim))), base, cos * base + np.sqrt(1 - cos**2) * side))
    return [(i, every[j].tolist(), int(i % 3 > 0)) for i, j in enumerate(rng.permutation(len(every)).tolist())]


@pytest.mark.parametrize("source", ["sf0.01", "hard"])
def test_recall_on_whole_tables(spark, source):
    if source == "hard":
        rows = hard_rows()
        frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    else:
        frame = spark.read.parquet(f"/root/testdata/{source}/embeddings.parquet")
        rows = [(r.vec_id, r.embedding, r.label) for r in frame.collect()]
    want = {r[0]: r for r in slow(rows)}
    got = {r.vec_id: tuple(r) for r in embed_dedup.linked(frame).collect()}
    assert got.keys() == want.keys()
    assert all(got[i][1] <= want[i][1] for i in want)
    assert sum(g[1] for g in got.values()) >= 0.98 * sum(w[1] for w in want.values())
    assert sum(got[i][2] == want[i][2] for i in want) >= 0.98 * len(want)
    pairs = [w for w in want.values() if 0 < w[1] < 10]  # links outside the large groups
    assert sum(got[w[0]][1] for w in pairs) >= 0.98 * sum(w[1] for w in pairs)


def test_traversal_visits_cells_in_order_of_score():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    grid = embed_dedup.Grid(x, 6, 0.9, 0.99)
    own, visits = grid.visits(x[:50])
    s = grid.scores(x[:50])
    width = len(grid.books[1])
    for i, cells in enumerate(visits):
        total = s[0][i][:, None] + s[1][i][None, :]
        assert cells[0] == own[i] and len(set(cells)) == len(cells)
        assert set(cells) == {int(a * width + b) for a, b in zip(*np.nonzero(total <= grid.limit))}
        assert np.all(np.diff([total[c // width, c % width] for c in cells]) >= 0)


def test_empty_table(spark):
    assert embed_dedup.linked(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []
