import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import Row

from tessera.llm import simhash


def slow_fingerprint(text):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    sh = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(ids, fps, radius=4):
    up = list(range(len(ids)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    return {x: min(g) for g in groups.values() for x in g}


def test_fingerprint_matches_the_definition():
    for t in [None, "", " \t\n", "One", "a b c", "A b  c\nd", "é ü É x y z w q " * 30, "a b c d e f g a b c d"]:
        assert simhash.fingerprint(t) == slow_fingerprint(t)


@pytest.mark.parametrize("radius", [0, 2, 4])
def test_bit_sliced_comparison_against_popcount(radius):
    rng = np.random.default_rng(radius)
    fps = rng.integers(0, 2**63, 300, dtype=np.uint64)
    for i in range(1, 300, 2):
        for b in rng.choice(64, rng.integers(0, 7), replace=False):
            fps[i] = fps[i - 1] ^ np.uint64(1 << int(b)) if b == 0 else fps[i] if i % 4 == 3 else fps[i - 1] ^ np.uint64((1 << int(b)) | 3)
    runs = np.sort(rng.integers(0, 60, 300))
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if runs[i] == runs[j] and int(fps[i] ^ fps[j]).bit_count() <= radius}
    i, j = simhash.near_by_shift(fps, runs, radius)
    assert set(zip(i.tolist(), j.tolist())) == want
    for q, lanes in simhash.near_by_query(fps[:40], fps, radius):
        assert lanes.tolist() == [j for j in range(300) if int(fps[q] ^ fps[j]).bit_count() <= radius]


def test_groups_against_brute_force(spark):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(200)]
    texts = [None, "", "  ", "one", "one"]
    for _ in range(40):
        base = [rng.choice(vocab) for _ in range(rng.randint(5, 300))]
        for _ in range(rng.randint(1, 5)):
            copy = list(base)
            if rng.random() < 0.7:
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            texts.append(" ".join(copy))
    rows = [Row(doc_id=i * 3, text=t, k=1, fp=None or 0) for i, t in enumerate(texts)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, k int, fp int")).collect()
    assert len(got) == len(texts)
    want = slow_components([r.doc_id for r in rows], [slow_fingerprint(t) for t in texts])
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.fingerprint for r in got} == {r.doc_id: f"{slow_fingerprint(r.text):016x}" for r in rows}


def test_one_key_dealt_as_chunks_loses_no_link(spark):
    rng = random.Random(5)
    fps = {rng.getrandbits(40) << 24 for _ in range(3)}
    for f in list(fps):
        fps |= {f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(60)}
    fps = sorted(fps)
    frame = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long")
    edges = [(r.fu % 2**64, r.fv % 2**64) for r in simhash.near_edges(frame, 4, chunk=16).collect()]
    assert all((u ^ v).bit_count() <= 4 for u, v in edges)
    up = {f: f for f in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for u, v in edges:
        up[max(find(u), find(v))] = min(find(u), find(v))
    assert {f: find(f) for f in fps} == slow_components(fps, fps)


def test_empty_table_and_repeated_rows(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    got = simhash.near_duplicates(spark.createDataFrame([(7, "a b"), (7, "a b"), (None, "a b")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got) == [(0, 7), (7, 7), (7, 7)]


def test_representatives(spark):
    rows = [(5, "a b", 1), (3, "a b", 2), (3, "a b", 2), (3, "x y z", 3), (None, "q r s", 4), (None, "t u v", 5), (None, "a b", 6), (9, None, 7), (8, " ", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, th int")
    out = simhash.representatives(docs)
    assert out.columns == docs.columns
    assert sorted(r.th for r in out.collect()) == [2, 3, 4, 5, 8]
    assert simhash.representatives(docs.limit(0)).collect() == []
