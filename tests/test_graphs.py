import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import box_quadratic, dual_flow, fusion_blocks, graph, kernels, primal_dual

NODE = "tumor_id string, mutation_id long, sample_id string, center double, h double, lower double, upper double"
EDGE = "tumor_id string, u long, v long, w double"


def test_primal_dual_is_admm_on_complete_graphs(spark):
    rng, rows, edges, want = np.random.default_rng(3), [], [], {}
    for name, m, s in (("A", 9, 2), ("B", 7, 3), ("C", 1, 2)):
        center, h = rng.choice([0.2, 0.5, 0.8], (m, 1)) + rng.normal(0, 0.08, (m, s)), rng.uniform(100, 1000, (m, s))
        lower, upper = np.full((m, s), 1e-6), np.full((m, s), 0.75)
        g = kernels.Graph(rng.uniform(0.2, 2, m * (m - 1) // 2) / max(m - 1, 1), m)
        want[name] = kernels.admm(g, center, h, lower, upper, 30.0, np.clip(center, lower, upper), np.zeros((len(g.w), s)), 20000, 1e-10)[0]
        rows += [(name, i, f"R{r}", float(center[i, r]), float(h[i, r]), 1e-6, 0.75) for i in range(m) for r in range(s)]
        edges += [(name, int(a), int(b), float(w)) for a, b, w in zip(g.u, g.v, g.w, strict=True)]
    nodes, edges = spark.createDataFrame(rows, NODE), spark.createDataFrame(edges, EDGE)
    solved = primal_dual.solve(nodes, edges, 30.0, tolerance=2e-6, most=400).persist()
    assert solved.filter("NOT converged").isEmpty()
    got = solved.collect()
    assert len(got) == 17 and len({r.rounds for r in got if r.tumor_id == "A"}) == 1
    assert max(np.abs(np.array(r.phi) - want[r.tumor_id][r.mutation_id]).max() for r in got) < 1e-4
    ends = {(r.tumor_id, r.u, r.v): np.array(r.dual) for r in primal_dual.duals(solved).collect()}
    assert len(ends) == 36 + 21 and all(np.linalg.norm(y) <= 30 * 2 / 6 + 1e-9 for y in ends.values())


def test_primal_dual_without_rows(spark):
    nodes, edges = spark.createDataFrame([], NODE), spark.createDataFrame([], EDGE)
    assert primal_dual.solve(nodes, edges, 1.0).count() == 0


def test_neighbours_are_sparse_and_add_up(spark):
    profile = spark.createDataFrame([("T", i, "R", float(i * i), True) for i in range(30)], "tumor_id string, mutation_id long, sample_id string, phi double, observed boolean")
    got = primal_dual.neighbour_edges(graph.distances(profile), spark.createDataFrame([("T", 0.5)], "tumor_id string, tau double"), 2).collect()
    want = {tuple(sorted((a, b))) for a in range(30) for b in sorted((x for x in range(30) if x != a), key=lambda x: (abs(x * x - a * a), x))[:2]}
    assert {(r.u, r.v) for r in got} == want
    assert sum(r.w for r in got) == pytest.approx(15)


def test_given_graphs_are_checked(spark):
    profile = spark.createDataFrame([("T", i, "R", 0.1 * i, True) for i in range(4)], "tumor_id string, mutation_id long, sample_id string, phi double, observed boolean")
    assert graph.resolved(profile).count() == 6
    edges = lambda *rows: spark.createDataFrame([("T", *r) for r in rows], EDGE)
    assert [(r.u, r.v) for r in graph.resolved(profile, edges((2, 1, 1.0), (0, 3, 0.0))).collect()] == [(1, 2)]
    for bad in ((0, 9, 1.0), (0, 0, 1.0), (0, 1, float("nan")), (0, 1, float("inf")), (0, 1, -1.0)):
        with pytest.raises(ValueError, match="edges must"):
            graph.resolved(profile, edges(bad))


def test_box_quadratic_is_the_bisection(spark):
    rng, rows, want = np.random.default_rng(1), [], {}
    for name, m in (("A", 1), ("B", 40)):
        target, h = rng.normal(5, 30, (m, 2)), rng.uniform(0, 50, (m, 2))
        lower, upper = np.zeros((m, 2)), np.where(rng.random((m, 2)) < 0.2, 0, rng.uniform(0.2, 1, (m, 2)))
        want[name] = kernels.box_sum(target, h, lower, upper, 2.0, rounds=80)
        rows += [(name, i, f"R{r}", float(target[i, r]), float(h[i, r]), 0.0, float(upper[i, r])) for i in range(m) for r in range(2)]
    got = box_quadratic.solved(spark.createDataFrame(rows, NODE.replace("center", "target")), 2.0).collect()
    assert len(got) == 82
    assert max(abs(r.x - want[r.tumor_id][r.mutation_id][int(r.sample_id[1])]) for r in got) < 1e-9


def brute(phi, labels, tolerance):
    blocks = [phi[labels == k] for k in np.unique(labels)]
    far = lambda a, b: max(float(np.linalg.norm(x - y)) for x in a for y in b)
    return all(far(b, b) <= tolerance for b in blocks), any(far(a, b) <= tolerance for a, b in itertools.combinations(blocks, 2))


def test_fusion_partition_is_all_pairs(spark):
    rng, rows, labels, want = np.random.default_rng(5), [], [], {}
    for t in range(24):
        centers = rng.uniform(0, 1, (6, 2)) * (1 if t % 3 else 0.3)
        own = rng.integers(0, 6, 30)
        phi = np.round(centers[own] + rng.uniform(-1, 1, (30, 2)) * (0.001, 0.036, 0.06, 0.02)[t % 4], 3)
        want[f"T{t}"] = brute(phi, own, 0.1)
        rows += [(f"T{t}", i, f"R{r}", float(phi[i, r]), True) for i in range(30) for r in range(2)]
        labels += [(f"T{t}", i, int(own[i])) for i in range(30)]
    profile = spark.createDataFrame(rows, "tumor_id string, mutation_id long, sample_id string, phi double, observed boolean")
    labels = spark.createDataFrame(labels, "tumor_id string, mutation_id long, cluster int")
    got = {r.tumor_id: r for r in fusion_blocks.fusion_partition(profile, labels, 0.1).collect()}
    assert {k: (r.within, r.mergeable) for k, r in got.items()} == want
    assert len(set(want.values())) > 2 and all(r.certified == (r.reason == "none") == (r.within and not r.mergeable) for r in got.values())
    assert sum(r.box_pairs + r.point_pairs for r in got.values()) < 24 * 435 / 3
    graphs = spark.createDataFrame([(f"T{t}", "g", "g" if t else "other") for t in range(23)], "tumor_id string, graph_hash string, certificate_hash string")
    again = {r.tumor_id: r.reason for r in fusion_blocks.fusion_partition(profile, labels, 0.1, graphs).collect()}
    assert {k for k, v in again.items() if v.startswith("dense_certificate")} == {"T0", "T23"}


def test_fusion_partition_of_odd_rows(spark):
    kind = "tumor_id string, mutation_id long, sample_id string, phi double, observed boolean"
    rows = [("A", 1, "R", 0.5, True), ("B", 1, "R", 0.5, True), ("B", 2, "R", 0.5, True), ("C", 1, "R", float("nan"), True), ("D", 1, "R", None, True)]
    labels = spark.createDataFrame([(t, m, m) for t, m, *_ in rows], "tumor_id string, mutation_id long, cluster int")
    got = {r.tumor_id: (r.within, r.mergeable, r.certified) for r in fusion_blocks.fusion_partition(spark.createDataFrame(rows, kind), labels, 0.1).collect()}
    assert got["A"] == (True, False, True) and got["B"] == (True, True, False)
    assert not got["C"][0] and not got["D"][0]
    empty = fusion_blocks.fusion_partition(spark.createDataFrame([], kind), labels.limit(0), 0.1)
    assert empty.count() == 0


@pytest.mark.parametrize("star", [False, True])
def test_flow_meets_the_targets(spark, star):
    rng, rows = np.random.default_rng(2), []
    for t in range(4):
        for i in range(12):
            for r in range(2):
                phi = 0.1 + 0.2 * (i % 3) + 0.05 * r
                kind = rng.integers(0, 4)
                rows.append((f"T{t}", i, f"R{r}", i % 3, phi, float(rng.normal(0, 5)), phi if kind in (1, 3) else 0.0, phi if kind in (2, 3) else 1.0))
    units = spark.createDataFrame(rows, "tumor_id string, mutation_id long, sample_id string, cluster int, phi double, gradient double, lower double, upper double")
    dual, demands = dual_flow.assembled(units, graph.uniform_edges(units), 3.0, star)
    got = dual_flow._by_region(demands, graph.adjoint(dual), "adj").withColumn("off", F.abs(F.col("gradient") + F.col("adj") - F.col("target")))
    assert got.count() == len(rows) and got.agg(F.max("off")).first()[0] < 1e-8
    sums = demands.groupBy("tumor_id", "cluster", "sample_id").agg(F.abs(F.sum("demand")).alias("s"))
    assert sums.agg(F.max("s")).first()[0] < 1e-8
    inner = dual.filter("inner").count()
    assert inner == 4 * (9 if star else 18)
    need = {r.tumor_id: r.required for r in dual_flow.required_penalty(dual).collect()}
    most = {}
    for r in dual.filter("inner").collect():
        most[r.tumor_id] = max(most.get(r.tumor_id, 0.0), float(np.linalg.norm(r.dual)) / r.w)
    assert need == pytest.approx(most)
