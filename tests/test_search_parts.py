"""Parts of the search that have no SQL, against definitions, brute force or the general form of the same operator."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.functions import special
from tessera.operators import fingerprints, graph, kernels, kkt, starts
from tessera.operators.partitions import complete_link_labels
from tessera.plans import cohort, start_queries

SF = "/root/testdata/sf0.001"
assert entry._registry() is cohort


def test_log_gamma(spark):
    xs = [1e-3, 0.1, 0.5, 1.0, 1.5, 2.0, 3.7, 10.0, 100.5, 1e4, 1e7]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(special.log_gamma("x")).collect()
    assert all(math.isclose(g[0], math.lgamma(x), rel_tol=1e-12, abs_tol=1e-10) for g, x in zip(got, xs, strict=True))


def test_roots_minima_and_sums(spark):
    one = spark.range(1)
    root = special.root_between(lambda x: x * x - 2, F.lit(0.0), F.lit(2.0))
    least = special.golden_minimum(lambda x: (x - 0.3) * (x - 0.3), F.lit(0.0), F.lit(1.0))
    edge = special.golden_minimum(lambda x: x, F.lit(0.25), F.lit(1.0))
    none = special.root_between(lambda x: x + 1, F.lit(0.0), F.lit(2.0))
    tiny = special.signed_log_sum(F.lit(1.0), F.lit(-900.0), F.lit(-1.0), F.lit(-901.0))
    got = one.select(root, least, edge, none, tiny, special.finite_or_null(F.lit(float("inf"))), special.geometric_middle(F.lit(0.01), F.lit(1.0))).first()
    assert math.isclose(got[0], math.sqrt(2), abs_tol=1e-9) and math.isclose(got[1], 0.3, abs_tol=1e-7) and math.isclose(got[2], 0.25, abs_tol=1e-9) and got[3] is None
    assert math.isclose(got[4], 1 - math.exp(-1)) and got[5] is None and math.isclose(got[6], 0.1)


def test_ambiguous_pilot_is_the_least_loss(spark):
    rng = np.random.default_rng(2)
    rows = [("t", i, "s", float(a), float(n - a), True, float(c), 1.0, 1, int(m), True) for i, (a, n, c, m) in enumerate((rng.integers(0, 60), 60, rng.uniform(0.1, 0.45), rng.integers(2, 4)) for _ in range(60))]
    rows.append(("t", 99, "s", 0.0, 0.0, True, 0.3, 1.0, 1, 2, True))
    units = spark.createDataFrame(rows, "tumor_id string, mutation_id long, sample_id string, alt double, nonalt double, observed boolean, scaling double, phi_upper double, multiplicity_low int, major_cn int, multiplicity_estimated boolean")
    got = {r.mutation_id: r for r in starts.best_betas(units).collect()}
    x = np.linspace(1e-6, 1, 40001)
    for _, i, _, a, r, _, c, _, low, major, _ in rows:
        q = [np.clip(c * m * x, 1e-6, 1 - 1e-6) for m in (low, major)]
        loss = -np.logaddexp(*[a * np.log(p) + r * np.log1p(-p) + math.log(0.5) for p in q])
        assert got[i].loss <= loss.min() + 1e-6
        at = np.array([got[i].beta])
        q = [np.clip(c * m * at, 1e-6, 1 - 1e-6) for m in (low, major)]
        assert math.isclose(got[i].loss, float(-np.logaddexp(*[a * np.log(p) + r * np.log1p(-p) + math.log(0.5) for p in q])[0]), abs_tol=1e-6)


def test_uniform_forms_equal_the_general_ones(spark):
    rng = np.random.default_rng(4)
    rows = [(t, m, s, float(np.round(rng.random(), 2) if m else 0.25), True) for t, n, regions in (("a", 30, "xyz"), ("b", 9, "xy"), ("c", 1, "x")) for m in range(n) for s in regions]
    profile = spark.createDataFrame(rows + [("b", 100, s, 0.25, True) for s in "xy"] + [("b", 101, s, 0.25, True) for s in "xy"], "tumor_id string, mutation_id long, sample_id string, phi double, observed boolean")
    diffs = graph.differences(profile, graph.uniform_edges(profile))
    dual = kkt.projected_dual(diffs, 1.0)
    want = {(r.tumor_id, r.mutation_id): r.adj for r in graph.adjoint(dual).collect()}
    got = {(r.tumor_id, r.mutation_id): r.adj for r in graph.uniform_flow(profile, 3).collect()}
    assert want.keys() <= got.keys() and len(got) == 30 + 11 + 1
    assert all(np.allclose(got[k], want.get(k, [0.0])) for k in got)
    flat = {(r.tumor_id, r.u, r.v): r["diff"] for r in diffs.collect()}
    assert flat == {(r.tumor_id, r.u, r.v): r["diff"] for r in graph.uniform_differences(profile).collect()} and len(flat) == 30 * 29 // 2 + 11 * 10 // 2
    norms = {(r.tumor_id, r.u, r.v): r.norm for r in graph.uniform_norms(profile, 3).collect()}
    assert all(math.isclose(norms[k], float(np.linalg.norm(d)), abs_tol=1e-12) for k, d in flat.items())
    a, b = ({r.tumor_id: (r.edge_residual, r.ball_residual) for r in x.collect()} for x in (kkt.edge_maxima(dual), kkt.uniform_maxima(profile, 3)))
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a)
    assert {tuple(r) for r in graph.degree_bound(graph.uniform_edges(profile)).collect()} == {tuple(r) for r in graph.complete_degree(profile).collect()}


@pytest.mark.parametrize("part", [1, 3, 1000])
def test_pairs_are_all_there_however_a_tumor_is_dealt(spark, monkeypatch, part):
    monkeypatch.setattr(graph, "PART", part)
    nodes = spark.createDataFrame([(t, m, float(m)) for t, n in (("a", 13), ("b", 1), ("c", 4)) for m in range(n)], "tumor_id string, mutation_id long, x double")
    got = sorted((r.tumor_id, r.u, r.v, r.x_u, r.x_v) for r in graph.pairs(nodes, "x").collect())
    assert got == sorted((t, u, v, float(u), float(v)) for t, n in (("a", 13), ("c", 4)) for u in range(n) for v in range(u + 1, n))
    assert graph.pairs(nodes, every=True).count() == 13 * 12 + 4 * 3


def test_complete_link_against_brute_force():
    rng = np.random.default_rng(7)
    for n, s, tol in ((0, 2, 0.1), (1, 1, 0.1), (60, 1, 0.05), (80, 2, 0.2), (80, 3, 0.5)):
        phi = np.round(rng.random((n, s)), 2)
        got = complete_link_labels(phi, tol)
        members = {}
        for i in sorted(range(n), key=lambda i: (*phi[i], i)):
            k = next((k for k, own in members.items() if all(np.linalg.norm(phi[i] - phi[j]) <= tol for j in own)), len(members))
            members.setdefault(k, []).append(i)
        want = np.empty(n, dtype=int)
        for r, own in enumerate(sorted(members.values(), key=min)):
            want[own] = r
        assert got.tolist() == want.tolist()


def test_empty_clusters_are_filled_and_anchors_refined():
    cost = np.array([[0.0, 1.0, 0.9], [0.0, 0.2, 5.0], [0.0, 3.0, 0.3], [0.0, 9.0, 9.0]])
    assert kernels.filled(np.zeros(4, dtype=int), cost).tolist() == [0, 1, 2, 0]
    assert kernels.filled(np.array([0, 1]), np.zeros((2, 3))).tolist() == [0, 1]
    assert kernels.finer_anchors(15, [*range(1, 16), 20, 25]) == [16, 17, 18, 19] and kernels.finer_anchors(3, [1, 2, 3, 4]) == []


def test_digests_depend_on_content_only(spark):
    rows = [("t", i, s, 0.1 * i) for i in range(600) for s in "ab"]
    frame = lambda x: spark.createDataFrame(x, "tumor_id string, mutation_id long, sample_id string, phi double")
    base = fingerprints.profile_digest(frame(rows)).first().profile_hash
    assert base == fingerprints.profile_digest(frame(rows[::-1]).repartition(3)).first().profile_hash
    changed = [("t", i, s, p + (1e-8 if i == 5 and s == "a" else 0.0)) for _, i, s, p in rows]
    assert base != fingerprints.profile_digest(frame(changed)).first().profile_hash
    two = [spark.range(1).select(fingerprints.row_digest(F.lit(a), F.lit(b))).first()[0] for a, b in (("ab", "c"), ("a", "bc"))]
    assert two[0] != two[1]


def test_file_digests_and_manifest(spark, tmp_path):
    import hashlib
    import json

    (tmp_path / "a.tsv").write_bytes(b"x\ty\n")
    files = fingerprints.file_digests(spark, str(tmp_path))
    assert files.first().sha256 == hashlib.sha256(b"x\ty\n").hexdigest()
    got = json.loads(fingerprints.manifest(files, seed=3, depth=100.0).first().manifest)
    assert got["settings"] == {"seed": "3", "depth": "100.0"} and got["files"][0]["length"] == 4


@pytest.mark.parametrize("name", ["ambiguous_pilot", "tumor_fingerprint"])
def test_queries_without_sql_give_rows(spark, name):
    got = cohort.QUERIES[name](spark, SF)
    assert name in start_queries.__dict__ and got.count() >= 0 and "tumor_id" in got.columns
