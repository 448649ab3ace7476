import random
import zlib

import numpy as np

from tessera.llm import toxicity

SF = "/root/testdata/sf0.1"


def test_isotonic_against_definition():
    rng = np.random.default_rng(0)
    raw, y = rng.integers(0, 12, 200).astype(float), rng.integers(0, 2, 200).astype(float)
    x, z = toxicity.isotonic(raw, y)
    assert (np.diff(z) >= -1e-12).all() and (np.diff(x) > 0).all()
    fit = np.interp(raw, x, z)
    # least squares of a monotone fit: max over i of min over k of the mean of [i, k]
    at = np.unique(raw)
    want = {v: max(min(y[(raw >= a) & (raw <= b)].mean() for b in at if b >= v) for a in at if a <= v) for v in at}
    assert np.allclose(fit, [want[v] for v in raw])


def test_features_of_odd_texts():
    lex = toxicity.Lexicon({"idiot": 3.0, "vequ-": 2.0})
    assert toxicity.features("", lex) == [0.0] * len(toxicity.FEATURES)
    f = dict(zip(toxicity.FEATURES, toxicity.features("YOU idiot, id1ot! vequxyz sooooo s.t.u.p.i.d", lex), strict=True))
    assert f["hits"] == 2 and f["entries"] == 2 and f["disguised_hits"] == 1 and f["near_second_person"] > 0
    assert f["weight_max"] == 3.0 and f["drawn_out"] > 0 and f["spaced_out"] > 0 and f["shouted"] > 0
    toxicity.features("a" * 200_000 + " b" * 200_000, lex)


def test_held_out_rows_are_told_apart(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.scored(docs, model).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    test = [(got[r.doc_id].predicted, r.toxic) for r in labels.collect() if got[r.doc_id].held_out]
    hit = sum(p and t for p, t in test)
    assert hit / max(1, sum(t for _, t in test)) >= 0.9 and hit / max(1, sum(p for p, _ in test)) > 0.95
    kept = toxicity.accepted(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in got.values())


def test_nothing_to_learn_from_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b", 9), (1, "a b", 9), (None, None, 9), (2, "", 9)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.scored(docs, toxicity.fit(docs, none)).collect()
    assert [(r.doc_id, r.score, r.predicted) for r in got] == [(1, 0.0, 0), (1, 0.0, 0), (None, 0.0, 0), (2, 0.0, 0)]
    one = spark.createDataFrame([(1, 0), (1, None), (None, 1), (2, 0), (77, 1)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.scored(docs, toxicity.fit(docs, one)).collect()} == {0.0}
    assert toxicity.accepted(docs, one).columns == docs.columns
    assert toxicity.scored(docs.limit(0), toxicity.fit(docs.limit(0), one)).collect() == []


def test_labels_of_held_out_rows_change_nothing(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["sun", "moon", "sea"]) for _ in range(20)) + (" vile" if i % 4 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    true = [(i, int(i % 4 == 0)) for i in range(400)]
    turned = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in true]
    a, b = ([tuple(r) for r in toxicity.scored(docs, toxicity.fit(docs, spark.createDataFrame(x, "doc_id long, toxic int"))).collect()] for x in (true, turned))
    assert a == b and all(r[3] == (r[0] % 4 == 0) for r in a)


def test_rare_words_of_a_minority_language_are_learned(spark):
    rows = [(i, int(i % 5 == 0), i % 4, "sun moon" + (f" odd{i % 700}" if i % 5 else " malvado" if i % 500 == 0 else " vile")) for i in range(5000)]
    full = toxicity.learn_lexicons(spark.createDataFrame(rows, "doc_id long, toxic int, fold int, text string"))[0]
    assert {"vile", "malvado"} <= set(full) and not {"sun", "moon"} & set(full)


def test_rows_pass_whatever_their_columns(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    odd = docs.selectExpr("doc_id", "text", "1 AS toxicity_score", "2 AS `a b`", "3 AS `text:x`", "4 AS score", "named_struct('x y', 5) AS row", "source AS Source2")
    got = toxicity.accepted(odd, labels)
    assert got.columns == odd.columns and got.schema == odd.schema
    want = {r.doc_id for r in toxicity.accepted(docs, labels).collect()}
    rows = got.collect()
    assert {r.doc_id for r in rows} == want and {(r.toxicity_score, r["a b"], r["text:x"], r.score, r.row["x y"]) for r in rows} == {(1, 2, 3, 4, 5)}


def slow_trees(x, y, rounds=5, depth=2, rate=0.2):
    """Boosting by the definition: each leaf is split where the gain over all features and thresholds is largest."""
    share = y.mean()
    raw = np.full(len(y), np.log(share / (1 - share)))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        grad, curve = y - p, p * (1 - p)
        parts = [np.arange(len(y))]
        for _ in range(depth):
            nxt = []
            for rows in parts:
                g, h, best = grad[rows].sum(), curve[rows].sum(), (1e-9, None)
                for f in range(x.shape[1]):
                    for cut in np.unique(x[:, f])[1:]:
                        low = rows[x[rows, f] < cut]
                        high = rows[x[rows, f] >= cut]
                        if curve[low].sum() < 0.25 or curve[high].sum() < 0.25:
                            continue
                        gain = grad[low].sum() ** 2 / (curve[low].sum() + 1) + grad[high].sum() ** 2 / (curve[high].sum() + 1) - g**2 / (h + 1)
                        if gain > best[0] + 1e-12:
                            best = (gain, (low, high))
                nxt += best[1] or (rows,)
            parts = nxt
        for rows in parts:
            raw[rows] += rate * grad[rows].sum() / (curve[rows].sum() + 1)
    return raw


def test_trees_against_the_definition():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 6, (120, 3)).astype(float)
    y = (rng.random(120) < 1 / (1 + np.exp(-(x[:, 0] - 2.5 + (x[:, 1] > 3) - rng.normal(0, 0.3, 120))))).astype(float)
    trees = toxicity.Trees(rounds=5, depth=2, bins=500).fit(x, y)
    assert np.allclose(trees.raw(x), slow_trees(x, y), atol=1e-9)


def test_scores_against_the_model_row_by_row(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.unionByName(spark.createDataFrame([(10**9, None), (10**9 + 1, ""), (10**9 + 2, "so " * 300_000), (10**9 + 2, "so " * 300_000)], "doc_id long, text string"), allowMissingColumns=True)
    model = toxicity.fit(docs, labels)
    got = sorted((r.doc_id, r.score, r.predicted, r.held_out) for r in toxicity.scored(docs, model).collect())
    want = []
    for r in docs.collect():
        x = np.array([toxicity.features(r.text or "", model.lexicon)])
        raw = model.trees.base
        for tree in model.trees.trees:  # one row, one tree at a time
            k = 0
            while tree[k][0] >= 0:
                k = 2 * k + 1 + int(np.searchsorted(model.trees.edges[tree[k][0]], x[0, tree[k][0]], "right") > tree[k][1])
            raw += tree[k][2]
        score = float(np.interp(raw, *model.knots))
        want.append((r.doc_id, score, int(score >= 0.5), zlib.crc32(str(r.doc_id).encode()) % 5 == 0))
    assert [(a, c, d) for a, _, c, d in got] == [(a, c, d) for a, _, c, d in sorted(want)]
    assert np.allclose([b for _, b, _, _ in got], [b for _, b, _, _ in sorted(want)], atol=1e-9)
