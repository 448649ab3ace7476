import random

import corpus_pipeline

import pyarrow as pa

from tessera.llm import shingle_dedup, simhash


def slow_shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def slow_groups(texts):
    sets, up = [slow_shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def edited_texts():
    rng = random.Random(3)
    vocab, texts = [f"w{i}" for i in range(500)], [None, "", "One two", "one  TWO"]
    for _ in range(40):
        base = [rng.choice(vocab) for _ in range(rng.randint(60, 300))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(1, 6)):
            copy, n = list(base), rng.randint(1, max(1, len(base) // 30))
            for at in rng.sample(range(len(copy)), n):
                copy[at] = rng.choice(vocab)
            texts.append(" ".join(copy))
    return texts


def test_stage_against_brute_force(spark):
    texts = edited_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = corpus_pipeline.remove_near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(set(slow_groups(texts)))
    assert corpus_pipeline.remove_near_duplicates(spark, docs.limit(0), "").collect() == []


def test_dealing_a_bucket_as_chunks_loses_no_link(spark):
    texts = edited_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    by_group = {}
    for r in shingle_dedup.grouped(docs, chunk=2).collect():
        by_group.setdefault(r.grp, []).append(r.doc_id)
    assert sorted(map(min, by_group.values())) == sorted(set(slow_groups(texts)))


def test_fingerprints_find_every_link_within_their_radius(spark, monkeypatch):
    """Without any band, what is left are texts of similarity 0.8 whose 5-word fingerprints lie within the radius; also in dense
    groups, whose comparison returns a forest only, and in buckets dealt as chunks."""
    rng = random.Random(5)
    words = [f"w{rng.randrange(500)}" for _ in range(400)]
    texts = edited_texts()
    for _ in range(60):
        copy = list(words)
        for at in rng.sample(range(len(copy)), rng.choice((1, 2, 8, 12))):
            copy[at] = f"w{rng.randrange(500)}"
        texts.append(" ".join(copy))
    sets, fps, up = [slow_shingles(t) for t in texts], [simhash.fingerprint(t, 5) for t in texts], list(range(len(texts)))
    near = [(i, j) for i in range(len(texts)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    same = [(i, j) for i, j in near if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    assert len(near) > len(same) > 100
    for i, j in same:
        a, b = up[i], up[j]
        up = [min(a, b) if x in (a, b) else x for x in up]

    def apart(batches):
        for b in batches:
            n = b.num_rows
            yield pa.record_batch([b.column(0), pa.array([0] * n, pa.int32()), b.column(0)], names=["k", "band", "node"])

    monkeypatch.setattr(shingle_dedup, "_banded", apart)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for chunk in (shingle_dedup.CHUNK, 7):
        groups = {}
        for r in shingle_dedup.grouped(docs, chunk=chunk).collect():
            groups.setdefault(r.grp, []).append(r.doc_id)
        got, want = {frozenset(g) for g in groups.values()}, {}
        for i, g in enumerate(up):
            want.setdefault(g, set()).add(i)
        # a leader is compared with its whole bucket, so links beyond the radius may be found as well
        assert all(any(w <= g for g in got) for w in want.values())
        full = slow_groups(texts)
        assert all(len({full[i] for i in g}) == 1 for g in got)
