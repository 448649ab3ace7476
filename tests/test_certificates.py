import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessera.operators import certificates as ct
from tessera.operators import kernels, refit
from tessera.plans.cohort import units

SF = "/root/testdata/sf0.001"
SCHEMA = "tumor_id string, mutation_id long, sample_id string, alt double, nonalt double, observed boolean, scaling double, phi_upper double, phi double, adj double, paths array<struct<switch:double,first:double,second:double,log_prior:double>>"


def rows_of(t, phi, adj, name="T"):
    m, s = t.shape
    return [
        (name, int(t.ids[i]), t.regions[r], float(t.alt[i, r]), float(t.ref[i, r]), bool(t.seen[i, r]), float(t.c[i, r]), float(t.upper[i, r]), float(phi[i, r]), float(adj[i, r]), [tuple(float(x[i, r, k]) for x in (t.switch, t.first, t.second, t.prior)) for k in range(t.switch.shape[2]) if np.isfinite(t.prior[i, r, k])])
        for i in range(m)
        for r in range(s)
    ]


def tumor(seed=0, m=12, s=2, kinks=False):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(m):
        for r in range(s):
            paths = [{"switch": 1.0, "first": 1.0, "second": 1.0, "log_prior": 0.0}] if not kinks else [{"switch": 0.4, "first": 1.0, "second": 2.0, "log_prior": np.log(0.5)}, {"switch": 0.6, "first": 2.0, "second": 1.0, "log_prior": np.log(0.5)}]
            n = 200
            rows.append(("T", i, f"R{r}", float(rng.binomial(n, 0.2 + 0.2 * (i % 3 == 0))), 0.0, True, 0.4, 1.0, paths))
            rows[-1] = (*rows[-1][:4], n - rows[-1][3], *rows[-1][5:])
    return kernels.Tumor(pd.DataFrame(rows, columns=kernels.COLUMNS))


def test_certificate_of_a_fit_is_the_kernels_residual(spark):
    t = tumor()
    phi = kernels.unit_minima(t)
    g = kernels.adaptive_graph(t, phi, kernels.pilot_curvature(t, phi))
    fit = kernels.fused_fit(t, g, 0.5, phi)
    frame = spark.createDataFrame(rows_of(t, fit.phi, g.adjoint(fit.dual)), SCHEMA)
    maxima = spark.createDataFrame([("T", 0.5, 0.0, 0.0, "g")], "tumor_id string, lam double, edge_residual double, ball_residual double, graph string")
    got = ct.certify(ct.one_sided(frame), maxima, "lam", 8e-4).first()
    assert got.stationarity <= fit.kkt + 1e-9 and got.box_residual == 0 and got.cert_status == ct.ANALYTIC and got.admissible
    assert got.certified == (got.kkt <= 8e-4)
    free = ct.certify(ct.one_sided(frame.withColumn("adj", F.lit(None).cast("double"))), maxima.limit(0), "lam", 8e-4).first()
    assert free.lam == 0 and free.cert_status == ct.NO_DUAL and free.stationarity > got.stationarity


def test_kinks_against_the_kernels(spark):
    t = tumor(1, kinks=True)
    phi = np.where(np.arange(12)[:, None] % 2 == 0, 0.4, 0.5) * np.ones(t.shape)
    adj = np.linspace(-300, 300, phi.size).reshape(phi.shape)
    got = {(r.mutation_id, r.sample_id): r for r in ct.generalized(ct.one_sided(spark.createDataFrame(rows_of(t, phi, adj), SCHEMA)), 1e-6).collect()}
    left, right = t.terms(phi)[1], t.terms(phi, right=True)[1]
    for i in range(12):
        for r in range(2):
            row = got[(i, f"R{r}")]
            assert row.at_kink == (i % 2 == 0)
            assert np.isclose(row.left, left[i, r]) and np.isclose(row.right, right[i, r])
            want = np.clip(-adj[i, r], min(left[i, r], right[i, r]), max(left[i, r], right[i, r])) if i % 2 == 0 else left[i, r]
            assert np.isclose(row.gradient, want)
            assert row.inadmissible == bool(i % 2 == 0 and left[i, r] > right[i, r] + 1e-6)
    assert any(r.inadmissible for r in got.values()) or all(r.left <= r.right + 1e-6 for r in got.values() if r.at_kink)


def test_blocks_stand_for_their_edges(spark):
    rng = np.random.default_rng(2)
    sizes, beta = np.array([3, 1, 4]), rng.random((3, 2))
    label = np.repeat(np.arange(3), sizes)
    phi, m, lam = beta[label], 8, 1.5
    adj = np.zeros_like(phi)
    for u in range(m):
        for v in range(m):
            d = phi[u] - phi[v]
            if np.linalg.norm(d) > 1e-6:
                adj[u] += lam / (m - 1) * d / np.linalg.norm(d)
    centers = spark.createDataFrame([("T", c, f"R{r}", float(beta[c, r])) for c in range(3) for r in range(2)], "tumor_id string, cluster int, sample_id string, beta double")
    flow, maxima = ct.block_flow(centers, spark.createDataFrame([("T", c, int(sizes[c]), lam) for c in range(3)], "tumor_id string, cluster int, size int, lam double"), "lam")
    for r in flow.collect():
        assert np.isclose(r.adj, adj[np.flatnonzero(label == r.cluster)[0], int(r.sample_id[1])])
    top = maxima.first()
    assert top.edge_residual < 1e-12 and top.ball_residual < 1e-12 and top.graph == "uniform:8"


def test_matrix_losses_are_the_kernels(spark):
    rows = units(spark, SF).filter("mutation_id < 20")
    got = {(r.tumor_id, r.mutation_id, r.sample_id): r.losses for r in refit.unit_losses(rows, 9).collect()}
    grid = 1e-6 + np.arange(9) * (1 - 1e-6) / 8
    seen = [r for r in rows.collect() if r.observed]
    assert len(got) == len(seen)
    for r in seen:
        p = np.array([[x.switch, x.first, x.second, x.log_prior] for x in r.paths])
        q = np.clip(r.scaling * (p[:, 1:2] * np.minimum(grid, p[:, :1]) + p[:, 2:3] * np.maximum(grid - p[:, :1], 0)), 1e-6, 1 - 1e-6)
        assert np.allclose(got[(r.tumor_id, r.mutation_id, r.sample_id)], -np.logaddexp.reduce(r.alt * np.log(q) + r.nonalt * np.log(1 - q) + p[:, 3:], axis=0))
