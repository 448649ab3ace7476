import math
import zlib

import numpy as np

from tessera.llm import quality

SF = "/root/testdata/sf0.1"


def test_vectors_of_odd_texts():
    words = quality.Words()
    at, value = quality.vector("", words)
    assert at.tolist() == [0] and value.tolist() == [1.0]
    for text in ("a", "!!", "a b", "été É ßß 日本 ___ 12ab", "x" * 100_000, "the " * 50_000, "\ud800 \x00"):
        at, value = quality.vector(text, words)
        assert len(at) == len(value) and ((at >= 0) & (at < quality.BUCKETS)).all()
        assert abs(float((value.astype(float) ** 2).sum()) - 3) < 1e-3  # the constant and two vectors of length one
    same, other = quality.vector("qu qu qu", words), quality.vector("xyz xyz xyz", words)
    assert len(set(same[0].tolist()) & set(other[0].tolist())) >= 5  # equal patterns of different words
    assert [quality._kind(w) for w in ("the", "The", "THE", "tHe", "a1", "!", "!!", "日本")] == [0, 1, 2, 3, 4, 5, 6, 7]


def test_updates_against_the_formulas():
    rng = np.random.default_rng(0)
    leader, z, n = quality.Leader(), {}, {}

    def weight(b):
        if abs(z.get(b, 0.0)) <= quality.L1:
            return 0.0
        return -(z[b] - math.copysign(quality.L1, z[b])) / ((quality.BETA + math.sqrt(n[b])) / quality.ALPHA + quality.L2)

    for _ in range(300):
        at = rng.choice(40, 6, replace=False)
        x, y = rng.random(6), float(rng.integers(0, 2))
        p = 1 / (1 + math.exp(-sum(weight(b) * v for b, v in zip(at.tolist(), x.tolist()))))
        for b, v in zip(at.tolist(), x.tolist()):
            g, w, old = (p - y) * v, weight(b), n.get(b, 0.0)
            n[b] = old + g * g
            z[b] = z.get(b, 0.0) + g - (math.sqrt(n[b]) - math.sqrt(old)) / quality.ALPHA * w
        leader.update(at, x, y)
    assert np.allclose(leader.weights(np.arange(40)), [weight(b) for b in range(40)], atol=1e-12)


def test_held_out_rows_are_told_apart(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality.scored(docs, quality.fit(docs, labels)).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    test = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert sum(p == q for p, q in test) / len(test) >= 0.99
    assert sum(not p for p, q in test if not q) / sum(not q for _, q in test) >= 0.97 and sum(p for p, q in test if q) / sum(q for _, q in test) >= 0.99


def test_held_out_labels_change_nothing_and_odd_rows(spark):
    texts = [f"plain words of a quiet text number {i}" for i in range(60)] + [f"BUY!! THIS!! NOW!! {i}" for i in range(60)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, None, "x"), (500, "", None), (500, "", None), (501, "w " * 200_000, "x"), (3, "another text of id 3", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    out = [zlib.crc32(str(i).encode()) % 3 == 1 for i in range(120)]
    known = [(i, int(i < 60)) for i in range(120)] + [(None, 1), (7, None), (9999, 0)]
    turned = [(i, (1 - q) if i is not None and i < 120 and out[i] and q is not None else q) for i, q in known]
    first, second = (quality.fit(docs, spark.createDataFrame(k, "doc_id long, quality int")) for k in (known, turned))
    assert np.array_equal(first.weights, second.weights)
    got = quality.scored(docs, first)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    got = got.collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if r.doc_id == 500}) == 1
    by = {r.doc_id: r.predicted for r in got if r.doc_id is not None and r.doc_id < 120 and r.doc_id != 3}
    assert all(by[i] == int(i < 60) for i in by)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.scored(docs, quality.fit(docs, none)).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1) for i in range(9)], "doc_id long, quality int")
    assert {r.score for r in quality.scored(docs, quality.fit(docs, one)).collect()} == {1.0}
    assert quality.scored(docs.limit(0), quality.fit(docs.limit(0), one)).collect() == []


def test_shards_are_averaged(spark, monkeypatch):
    monkeypatch.setattr(quality, "SHARD_ROWS", 30)
    rows = [(i, f"plain words of text {i} and more" if i % 2 else f"### {i} $$$ words ***") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    got = quality.scored(docs, quality.fit(docs, labels)).collect()
    assert all(r.predicted == r.doc_id % 2 for r in got)
