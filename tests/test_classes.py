"""What is summed over classes of equal profiles equals what all pairs of mutations give, without a row for each of these."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import dual_flow, graph, kkt, partitions, primal_dual

ROW = "tumor_id string, mutation_id long, sample_id string, phi double, observed boolean"


def made(spark, seed=1):
    """Tumors of 40 mutations with 7 profiles, of 25 without equal ones, of 12 with a profile, of one."""
    rng, rows = np.random.default_rng(seed), []
    for name, m, kinds in (("A", 40, 7), ("B", 25, 25), ("C", 12, 1), ("D", 1, 1)):
        places, seen = np.round(rng.random((kinds, 3)), 2), rng.random((m, 3)) < 0.7
        rows += [(name, 3 * i + 1, "xyz"[r], float(places[i % kinds, r]), bool(seen[i, r])) for i in range(m) for r in range(3)]
    return spark.createDataFrame(rows, ROW)


def test_class_pairs_stand_for_all_pairs(spark):
    nodes, names = graph.columns_of(made(spark), 3)
    found = graph.classes(nodes, *names)
    got = {r.tumor_id: (r.n, r.rows) for r in graph.class_pairs(found, *names).groupBy("tumor_id").agg(F.sum("k").alias("n"), F.count("*").alias("rows")).collect()}
    assert got == {"A": (780, 28), "B": (300, 300), "C": (66, 1)}


def test_many_equal_mutations_are_few_rows(spark):
    """12,000 mutations with four profiles: 72 million pairs, of which none is made."""
    rows = spark.range(12000).select(F.lit("T").alias("tumor_id"), F.col("id").alias("mutation_id"), F.lit("x").alias("sample_id"), (F.col("id") % 4 / 10).alias("phi"), F.lit(True).alias("observed"))
    nodes, names = graph.columns_of(rows, 1)
    assert graph.class_pairs(graph.classes(nodes, *names), *names).count() == 10
    got = graph.uniform_activity(rows, 1, 0.05).first()
    assert (got.fused, got.apart) == (4 * 3000 * 2999 // 2, 6 * 3000 * 3000)
    assert graph.uniform_penalty(rows, 1).first().penalty == pytest.approx(9e6 * (0.3 + 2 * 0.2 + 3 * 0.1) / 11999)
    assert {(round(r.mutation_id % 4 / 10, 1), round(r.adj[0], 9)) for r in graph.uniform_flow(rows, 1).collect()} == {(i / 10, round(3000 * (2 * i - 3) / 11999, 9)) for i in range(4)}


def test_penalty_and_activity(spark):
    profile = made(spark)
    diffs = graph.uniform_differences(profile)
    want = {r.tumor_id: r.penalty for r in graph.penalty(diffs, 2.0).collect()}
    assert {r.tumor_id: r.penalty for r in graph.uniform_penalty(profile, 3, 2.0).collect()} == pytest.approx(want)
    assert sorted(map(tuple, graph.uniform_activity(profile, 3, 0.3).collect())) == sorted(map(tuple, graph.activity(diffs, 0.3).collect()))
    dual = kkt.projected_dual(diffs, 1.0)
    a, b = ({r.tumor_id: (r.edge_residual, r.ball_residual) for r in x.collect()} for x in (kkt.edge_maxima(dual), kkt.uniform_maxima(profile, 3)))
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a)


def test_diameters_and_cross_distances(spark):
    rng = np.random.default_rng(3)
    place = {(t, i): rng.random(3).round(2 if t == "A" else 6) for t, m in (("A", 50), ("B", 60)) for i in range(m)}
    rows = [(t, i, "xyz"[r], float(x[r]), True) for (t, i), x in place.items() for r in range(3)]
    rows += [("N", i, "x", x, True) for i, x in enumerate((0.1, 0.2, float("nan")))]
    profile = spark.createDataFrame(rows, ROW)
    labels = profile.select("tumor_id", "mutation_id", F.when(F.col("tumor_id") == "N", 0).otherwise(F.least(F.col("mutation_id") % 4, F.lit(49) - F.col("mutation_id")).cast("int")).alias("cluster")).distinct()
    blocks = {}
    for r in labels.filter("tumor_id <> 'N'").collect():
        blocks.setdefault((r.tumor_id, r.cluster), []).append(place[r.tumor_id, r.mutation_id])
    far = lambda a, b, f=max: f(float(np.linalg.norm(x - y)) for x in a for y in b)
    got = {(r.tumor_id, r.cluster): r.diameter for r in partitions.diameters(profile, labels).collect()}
    assert np.isnan(got.pop(("N", 0))) and got == pytest.approx({k: far(x, x) for k, x in blocks.items()})
    cross = {(r.tumor_id, r.a, r.b): (r.farthest, r.nearest) for r in partitions.cross_distances(profile, labels).collect()}
    want = {(a[0], a[1], b[1]): (far(blocks[a], blocks[b]), far(blocks[a], blocks[b], min)) for a, b in itertools.permutations(blocks, 2) if a[0] == b[0] and a[1] < b[1]}
    assert cross.keys() == want.keys() and all(cross[k] == pytest.approx(want[k]) for k in want)


def test_components_with_equal_and_unobserved(spark):
    rows = [("T", i, "x", x, True) for i, x in enumerate((0.1, 0.1, 0.15, 0.5, 0.5, 0.9))] + [("T", i, "x", 0.3, False) for i in (6, 7)]
    profile = spark.createDataFrame(rows, ROW)
    got = lambda tol: sorted((r.mutation_id, r.component) for r in partitions.components(profile, tol).collect())
    assert got(0.06) == [(0, 0), (1, 0), (2, 0), (3, 3), (4, 3), (5, 5), (6, 6), (7, 7)]
    assert got(1.0) == [(i, 0) for i in range(8)]


def test_components_of_a_long_chain(spark):
    """A chain in an odd order takes many rounds; with sizes estimated round upon round planning took twice as long each time."""
    order = np.random.default_rng(0).permutation(50)
    profile = spark.createDataFrame([("T", int(m), "x", 0.01 * i, True) for i, m in enumerate(order)], ROW)
    assert {(r.component) for r in partitions.components(profile, 0.015).collect()} == {0}


@pytest.mark.parametrize("chunk", [3, 2048])
def test_nearest_edges_are_those_of_all_distances(spark, monkeypatch, chunk):
    monkeypatch.setattr(primal_dual, "CHUNK", chunk)
    profile = made(spark, 5)
    tau = profile.select("tumor_id").distinct().withColumn("tau", F.lit(0.05))
    want = {(r.tumor_id, r.u, r.v): r.w for r in primal_dual.neighbour_edges(graph.distances(profile), tau, 3).collect()}
    assert {(r.tumor_id, r.u, r.v): r.w for r in primal_dual.nearest_edges(profile, tau, 3, 3).collect()} == pytest.approx(want)


def test_adaptive_weights_average(spark):
    profile = made(spark, 7)
    got = graph.adaptive_edges(profile, profile.select("tumor_id").distinct().withColumn("tau", F.lit(0.05)), baseline=2.0).groupBy("tumor_id").agg(F.avg("w").alias("w"), F.count("*").alias("n"))
    assert {r.tumor_id: (round(r.w, 9), r.n) for r in got.collect()} == {"A": (round(2 / 39, 9), 780), "B": (round(2 / 24, 9), 300), "C": (round(2 / 11, 9), 66)}


def test_uniform_flow_within_blocks(spark):
    rng, rows = np.random.default_rng(2), []
    for t, m in (("A", 24), ("B", 9), ("C", 1)):
        for i in range(m):
            for r in range(2):
                phi, kind = 0.1 + 0.2 * (i % 3) + 0.05 * r, rng.integers(0, 4)
                rows.append((t, i, f"R{r}", i % 3, phi, float(rng.integers(-9, 9)), phi if kind in (1, 3) else 0.0, phi if kind in (2, 3) else 1.0))
    units = spark.createDataFrame(rows, "tumor_id string, mutation_id long, sample_id string, cluster int, phi double, gradient double, lower double, upper double")
    dual, demands = dual_flow.assembled(units, graph.uniform_edges(units), 3.0)
    every = {(r.tumor_id, r.mutation_id, r.sample_id): (r.adj, r.total, r.target) for r in dual_flow._by_region(demands, graph.adjoint(dual), "adj").collect()}
    sums = dual_flow.uniform_sums(units, 3.0, 2).persist()
    got = {(r.tumor_id, r.mutation_id, r.sample_id): (r.adj, r.total, r.target) for r in sums.collect()}
    assert every.keys() == got.keys() and all(np.allclose(got[k], every[k], atol=1e-9) for k in every)
    assert {r.tumor_id: r.required for r in dual_flow.uniform_required(sums, 2).collect()} == pytest.approx({r.tumor_id: r.required for r in dual_flow.required_penalty(dual).collect()})
