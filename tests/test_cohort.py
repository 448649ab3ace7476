import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.functions import likelihood as L
from tessera.operators import kernels, paths, refit, scores, validate
from tests.compare_rows import compare, views

cohort = entry._registry()

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(n for n in cohort.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    views(con, SF)
    assert compare(cohort.QUERIES[name](spark, SF), con.execute(cohort.ORACLE_SQL[name])).startswith("same")


def test_entry(spark):
    assert entry.entry(spark).count() == 25


STATES = [(1, 1, 0.4), (2, 1, 0.6)]


@pytest.mark.parametrize(("penalty", "want"), [(3.0, [0.03816999, 0.03816999, 0.92366001]), (0.0, [1 / 6, 1 / 6, 2 / 3])])
def test_worked_path_priors(spark, penalty, want):
    frame = spark.createDataFrame([(STATES,)], "states array<struct<a:int,b:int,f:double>>")
    got = paths.compiled(frame, penalty).first().paths
    assert [(p.first, p.second, p.switch) for p in got] == [(1, 2, 0.4), (2, 1, 0.6), (1, 1, 1.0)]
    assert np.allclose([math.exp(p.log_prior) for p in got], want, atol=1e-8)


def test_states_without_paths(spark):
    rows = [([(0, 0, 1.0)],), ([(1, 0, 0.2), (1, 1, 0.3), (2, 1, 0.5)],), ([(2, 0, 1.0)],)]
    got = {len(r.states): [(p.first, p.switch) for p in r.paths] for r in paths.compiled(spark.createDataFrame(rows, "states array<struct<a:int,b:int,f:double>>")).collect()}
    assert got == {1: [(1.0, 1.0), (2.0, 1.0)]}


@pytest.mark.parametrize(
    ("phi", "loss", "gradient", "curvature", "mass", "entropy"),
    [(0.4, 64.794828, -14.191754, 240.354025, 0.799298, 0.013181), (0.5, 64.362122, 2.158724, 187.862729, 0.952696, 0.399022), (0.6, 63.774505, -14.265597, 154.155302, 0.736358, 0.942757), (0.9, 61.188041, -1.500129, 51.535922, 0.900195, 0.003508)],
)
def test_worked_likelihood(spark, phi, loss, gradient, curvature, mass, entropy):
    frame = paths.compiled(spark.createDataFrame([(STATES,)], "states array<struct<a:int,b:int,f:double>>"))
    row = frame.select("paths", F.lit(30.0).alias("alt"), F.lit(70.0).alias("nonalt"), F.lit(phi).alias("phi"), F.lit(0.8 / (0.2 * 2 + 0.8 * 2.6)).alias("scaling"), F.lit(True).alias("observed"))
    row = row.withColumn("terms", L.log_terms()).withColumn("post", L.posterior())
    s = L.path_summary()
    got = row.select(L.loss(), L.gradient(), L.curvature(), s["posterior_mutant_copy_mass"], s["path_entropy"]).first()
    assert np.allclose(list(got), [loss, gradient, curvature, mass, entropy], atol=2e-6)
    hidden = row.withColumn("observed", F.lit(False)).withColumn("post", L.posterior())
    assert list(hidden.select(L.loss(), L.gradient(), L.curvature()).first()) == [0, 0, 0]


def test_worked_scores(spark):
    sizes = spark.createDataFrame([("t", 0, 3), ("t", 1, 2)], "tumor_id string, cluster int, size long")
    assert math.isclose(scores.partition_log_mass(sizes).first().log_mass, math.log(1 / 30), abs_tol=1e-9)
    counts = spark.createDataFrame([("t", 15, 0.0, 3)], "tumor_id string, n_eff long, depth double, n_regions long")
    fits = spark.createDataFrame([("t", -100.0, 2)], "tumor_id string, loglik double, k long")
    out = scores.dirichlet_score(counts, fits, sizes).first()
    assert math.isclose(out.bic, 216.2483012066, abs_tol=1e-8) and math.isclose(out.score, 221.0099775409, abs_tol=1e-8)
    assert math.isclose(kernels.log_mass(np.array([3, 2])), math.log(1 / 30), abs_tol=1e-12)


def text_row(**change):
    base = {"tumor_id": "t", "mutation_id": "m", "sample_id": "s", "alt_count": "3", "ref_count": "12.0", "count_observed": "1", "purity": "0.5", "normal_cn": "2", "segment_id": "g", "cn_state_id": "c", "cn_state_fraction": "1", "allele_a_cn": "1", "allele_b_cn": "1"}
    return base | change


@pytest.mark.parametrize(
    ("change", "error"),
    [({}, None), ({"count_observed": "0", "alt_count": ".", "ref_count": "."}, None), ({"mutation_id": "#m"}, "mutation_id"), ({"sample_id": " s"}, "sample_id"), ({"segment_id": "."}, "segment_id"), ({"cn_state_id": "a\tb"}, "cn_state_id"),
     ({"alt_count": "-1"}, "alt_count"), ({"ref_count": "1.5"}, "ref_count"), ({"alt_count": "."}, "alt_count"), ({"count_observed": "yes"}, "count_observed"), ({"purity": "0"}, "purity"), ({"purity": "1.1"}, "purity"), ({"purity": "NaN"}, "purity"),
     ({"normal_cn": "inf"}, "normal_cn"), ({"cn_state_fraction": "0"}, "cn_state_fraction"), ({"allele_a_cn": "0"}, "alleles"), ({"allele_b_cn": "x"}, "alleles")],
)
def test_malformed_rows(spark, change, error):
    row = validate.normalized(spark.createDataFrame([text_row(**change)])).first()
    assert [e.split(":")[0] for e in row.errors] == ([error] if error else [])


def test_group_checks(spark):
    base = {"tumor_id": "t", "mutation_id": "m", "sample_id": "s", "alt_count": 1, "ref_count": 2, "count_observed": True, "purity": 0.5, "normal_cn": 2.0, "segment_id": "g", "cn_state_id": "c", "cn_state_fraction": 1.0, "allele_a_cn": 1, "allele_b_cn": 1}

    def found(*rows):
        return {r.problem for r in validate.problems(spark.createDataFrame([base | r for r in rows])).collect()}

    assert found({}) == set()
    assert found({}, {}) == {"repeated state of a unit"}
    assert found({}, {"mutation_id": "n", "purity": 0.6}) == {"purity varies in a sample"}
    assert found({"cn_state_fraction": 0.9}) == {"fractions do not sum to 1"}
    assert found({}, {"mutation_id": "n", "sample_id": "z"}) == {"missing unit"}
    assert found({"cn_state_fraction": 0.5}, {"cn_state_fraction": 0.5, "cn_state_id": "d", "allele_a_cn": 2}, {"mutation_id": "n", "cn_state_fraction": 0.5}) == {"incomplete states of a unit"}
    assert "disagreeing rows of a unit" in found({"cn_state_fraction": 0.5}, {"cn_state_fraction": 0.5, "cn_state_id": "d", "alt_count": 7})


@pytest.fixture(scope="module")
def tumor(spark):
    rows = cohort.units(spark, SF).select(*kernels.COLUMNS).filter("tumor_id = 'Brand#1'").toPandas()
    return kernels.Tumor(rows)


def test_ward_against_brute_force():
    rng = np.random.default_rng(0)
    phi, h = rng.random((12, 2)), rng.random((12, 2)) + 0.1
    got = kernels.ward(phi, h, set(range(1, 13)))
    groups = [([i], h[i], phi[i]) for i in range(12)]
    while len(groups) > 1:
        cost = {(i, j): 0.5 * (a[1] * b[1] / (a[1] + b[1]) * (a[2] - b[2]) ** 2).sum() for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j}
        i, j = min(cost, key=cost.get)
        a, b = groups[i], groups[j]
        groups = [g for k, g in enumerate(groups) if k not in (i, j)] + [(a[0] + b[0], a[1] + b[1], (a[1] * a[2] + b[1] * b[2]) / (a[1] + b[1]))]
        labels = got[len(groups)]
        assert {tuple(sorted(g[0])) for g in groups} == {tuple(np.flatnonzero(labels == k)) for k in range(len(groups))}


def test_certified_minimum_bounds_the_grid(tumor):
    own = np.arange(len(tumor.ids))
    for r in range(tumor.shape[1]):
        beta, value, low, ok, _ = kernels.certified_minimum(tumor, own, r)
        x = np.linspace(kernels.EPS, 1, 3001)
        grid = tumor.terms(np.repeat(x[:, None], len(own), 1), own, np.full(len(own), r))[0].sum(1)
        assert ok and low <= value <= grid.min() + 1e-9 and value - low <= 1e-4


def test_fused_fit_descends_to_stationarity(tumor):
    phi = kernels.unit_minima(tumor)
    g = kernels.adaptive_graph(tumor, phi, kernels.pilot_curvature(tumor, phi))
    for lam in (0.0, 0.5, 50.0):
        f = kernels.fused_fit(tumor, g, lam, phi)
        assert f.objective <= tumor.terms(phi)[0].sum() + lam * g.penalty(phi) + 1e-6
        assert f.kkt <= 4e-3
        assert (f.phi >= tumor.lower).all() and (f.phi <= tumor.upper).all()


def test_cem_improves_and_search_selects(tumor):
    phi = kernels.unit_minima(tumor)
    start = kernels.ward(phi, kernels.pilot_curvature(tumor, phi), {3})[3]
    labels, fit, value = kernels.cem(tumor, start)
    assert value <= kernels.score(tumor, start, kernels.refit(tumor, start).loss) + 1e-9
    out = kernels.search(tumor, explore=2, refine=1)
    assert out.score <= value + 1e-6 and len(out.labels) == len(tumor.ids) and out.candidates >= 1


def test_complete_link_and_components(spark):
    phi = np.array([[0.0], [0.06], [0.12], [0.3]])
    from tessera.operators import partitions

    assert partitions.complete_link_labels(phi, 0.1).tolist() == [0, 0, 1, 2]
    frame = spark.createDataFrame([("t", i, "s", float(x), True) for i, x in enumerate(phi[:, 0])], "tumor_id string, mutation_id long, sample_id string, phi double, observed boolean")
    assert sorted((r.mutation_id, r.component) for r in partitions.components(frame, 0.1).collect()) == [(0, 0), (1, 0), (2, 0), (3, 3)]


def test_canonical_labels():
    assert kernels.canonical(np.array([7, 3, 7, 1])).tolist() == [0, 1, 0, 2]


def test_refined_centers_do_not_get_worse(spark):
    units = cohort.units(spark, SF).filter("tumor_id = 'Brand#1'")
    first = refit.best_centers(refit.loss_grid(units))
    after = refit.refined_centers(units, first, 1 / 63)
    both = first.alias("a").join(after.alias("b"), ["tumor_id", "cluster", "sample_id"]).select(F.col("a.loss").alias("x"), F.col("b.loss").alias("y")).toPandas()
    assert isinstance(both, pd.DataFrame) and (both.y <= both.x + 1e-9).all()


def test_adjoint_forms_agree(spark):
    from tessera.operators import graph

    dual = spark.createDataFrame([("t", 1, 2, [1.0, 2.0]), ("t", 1, 3, [0.5, -1.0]), ("t", 2, 3, [4.0, 0.0])], "tumor_id string, u long, v long, dual array<double>")
    want = {1: [1.5, 1.0], 2: [3.0, -2.0], 3: [-4.5, 1.0]}
    assert {r.mutation_id: list(r.adj) for r in graph.adjoint(dual).collect()} == want == {r.mutation_id: list(r.adj) for r in graph.adjoint(dual, 2).collect()}
