"""Queries over certificates: of a profile with units on their kinks, and of the seven real candidates with what follows from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import candidates as cd
from tessera.operators import certificates as ct
from tessera.operators import graph, kkt, partitions, scores
from tessera.plans.cohort import FIT_SQL, KEY, PARTS, REGIONS, _r, fitted, query, units
from tessera.plans.selection_queries import CANDS, candidate_labels

#: Tolerance of the stand-in profile's certificates, and of the candidates': residuals are relative, so at most one, and these
#: profiles are no optima, so the last candidates pass only by a tolerance above that.
TOLERANCE = 0.97
LENIENT = 1.000001

# A third of the mutations sit exactly on the least switch of their paths.
PARTS["kinked"] = """kinked AS (SELECT p.* REPLACE (CASE WHEN p.mutation_id % 3 = 0 AND s.x < 1 THEN s.x ELSE p.phi END AS phi) FROM (SELECT *, phi AS plain FROM prof) p
  JOIN (SELECT tumor_id, sample_id, segment_id, MIN(switch) AS x FROM path GROUP BY ALL) s USING (tumor_id, sample_id, segment_id)),
slopes AS (SELECT *, first * least(phi, switch) + second * greatest(phi - switch, 0) AS mass, [switch, CASE WHEN 1e-6 / c <= first * switch THEN 1e-6 / c / first ELSE switch + (1e-6 / c - first * switch) / second END,
    CASE WHEN (1 - 1e-6) / c <= first * switch THEN (1 - 1e-6) / c / first ELSE switch + ((1 - 1e-6) / c - first * switch) / second END] AS bends
  FROM kinked JOIN (SELECT tumor_id, sample_id, segment_id, switch, first, second, log_prior FROM path) USING (tumor_id, sample_id, segment_id)),
slope2 AS (SELECT *, least(greatest(c * mass, 1e-6), 1 - 1e-6) AS q, CASE WHEN c * mass > 1e-6 AND c * mass <= 1 - 1e-6 THEN c * CASE WHEN phi <= switch THEN first ELSE second END ELSE 0 END AS dl,
  CASE WHEN c * mass >= 1e-6 AND c * mass < 1 - 1e-6 THEN c * CASE WHEN phi < switch THEN first ELSE second END ELSE 0 END AS dr FROM slopes),
slope3 AS (SELECT *, exp(j - MAX(j) OVER w) AS e FROM (SELECT *, alt * ln(q) + nonalt * ln(1 - q) + log_prior AS j FROM slope2) WINDOW w AS (PARTITION BY tumor_id, mutation_id, sample_id)),
sided AS (SELECT tumor_id, mutation_id, sample_id, any_value(phi) AS phi, any_value(count_observed) AS seen, bool_or(len(list_filter(bends, lambda x: x > 0 AND x < 1 AND x = phi)) > 0) AS at_kink,
  CASE WHEN bool_and(count_observed) THEN -SUM(e * dl * (alt / q - nonalt / (1 - q))) / SUM(e) ELSE 0e0 END AS left_slope,
  CASE WHEN bool_and(count_observed) THEN -SUM(e * dr * (alt / q - nonalt / (1 - q))) / SUM(e) ELSE 0e0 END AS right_slope FROM slope3 GROUP BY tumor_id, mutation_id, sample_id),
kvec AS (SELECT tumor_id, mutation_id, list(phi ORDER BY sample_id) AS x FROM sided GROUP BY tumor_id, mutation_id),
kedge AS (SELECT *, sqrt(list_sum(list_transform(diff, lambda x: x * x))) AS nrm FROM (SELECT a.tumor_id, a.mutation_id, 1e0 / greatest(m - 1, 1) AS w, list_transform(range(1, len(a.x) + 1), lambda i: a.x[i] - b.x[i]) AS diff
  FROM kvec a JOIN kvec b ON a.tumor_id = b.tumor_id AND a.mutation_id <> b.mutation_id JOIN (SELECT tumor_id, COUNT(*) AS m FROM kvec GROUP BY tumor_id) s ON s.tumor_id = a.tumor_id)),
kadj AS (SELECT tumor_id, mutation_id, i, SUM(CASE WHEN nrm > 1e-6 THEN w * diff[i] / nrm ELSE 0 END) AS y FROM kedge, unnest(range(1, len(diff) + 1)) t(i) GROUP BY ALL),
kunit AS (SELECT *, CASE WHEN at_kink THEN least(greatest(-y, least(left_slope, right_slope)), greatest(left_slope, right_slope)) ELSE left_slope END AS g, at_kink AND left_slope > right_slope + 97e-2 AS down FROM (
  SELECT *, row_number() OVER (PARTITION BY tumor_id, mutation_id ORDER BY sample_id) AS i FROM sided) JOIN kadj USING (tumor_id, mutation_id, i)),
kcert AS (SELECT tumor_id, MAX(abs(CASE WHEN phi = 1e-6 THEN least(g + y, 0) WHEN phi = 1 THEN greatest(g + y, 0) ELSE g + y END) / greatest(1, abs(g) + abs(y))) AS stationarity, COUNT(*) FILTER (at_kink) AS n_kinks, COUNT(*) FILTER (down) AS n_downward FROM kunit GROUP BY tumor_id),
kmax AS (SELECT tumor_id, MAX(CASE WHEN pn >= w THEN CASE WHEN nrm > 1e-6 THEN 0e0 ELSE w * nrm / greatest(pn, 1e-300) END ELSE nrm END / greatest(1, w)) AS edge_residual FROM (SELECT *, CASE WHEN nrm > 1e-6 THEN nrm + w ELSE nrm END AS pn FROM kedge) GROUP BY tumor_id)"""
KINKED = (*FIT_SQL, "kinked")


def kinked(spark, sf_dir):
    """The stand-in profile, with every third mutation on the least switch of its paths."""
    rows = fitted(spark, sf_dir)
    x = F.array_min(F.transform("paths", lambda p: p["switch"]))
    return rows.withColumn("phi", F.when((F.col("mutation_id") % 3 == 0) & (x < 1), x).otherwise(F.col("phi")))


@query(KINKED, "SELECT tumor_id, mutation_id, sample_id, at_kink, round(left_slope, 4) + 0.0 AS left_slope, round(right_slope, 4) + 0.0 AS right_slope, round(g, 4) + 0.0 AS gradient, down AS inadmissible FROM kunit")
def kink_gradients(spark, sf_dir):
    rows = kinked(spark, sf_dir)
    out = ct.generalized(_with_flow(ct.one_sided(rows), graph.uniform_flow(rows, len(REGIONS))), TOLERANCE)
    return out.select(*KEY, "at_kink", _r("left", 4).alias("left_slope"), _r("right", 4).alias("right_slope"), _r("gradient", 4).alias("gradient"), "inadmissible")


def _with_flow(rows, flow):
    """Units with the part of their mutation's flow, an array by region, that is their own region's."""
    ids = rows.groupBy("tumor_id").agg(F.array_sort(F.collect_set("sample_id")).alias("regions"))
    rows = rows.join(ids, "tumor_id").join(flow.withColumnRenamed("adj", "flow"), ["tumor_id", "mutation_id"], "left")
    return rows.withColumn("adj", F.coalesce(F.get("flow", F.array_position("regions", F.col("sample_id")).cast("int") - 1), F.lit(0.0))).drop("flow", "regions")


@query(KINKED, """SELECT tumor_id, 1e0 AS lam, round(stationarity, 6) AS stationarity, round(edge_residual, 6) + 0.0 AS edge_residual, 0e0 AS ball_residual, round(greatest(stationarity, edge_residual), 6) AS kkt, 97e-2 AS kkt_tolerance, n_kinks, n_downward,
  greatest(stationarity, edge_residual) <= 97e-2 AS certified, n_downward = 0 AS admissible, greatest(stationarity, edge_residual) <= 97e-2 AND n_downward = 0 AS objective_certified,
  CASE WHEN n_kinks > 0 THEN 'clarke_piecewise_observed_objective_subgradient' ELSE 'observed_objective' END AS gradient_scope, 'analytic_nonfused_dual' AS cert_status, sha256('uniform:' || m) AS graph_hash
  FROM kcert JOIN kmax USING (tumor_id) JOIN (SELECT tumor_id, COUNT(*) AS m FROM kvec GROUP BY tumor_id) USING (tumor_id)""")  # fmt: skip
def certify(spark, sf_dir):
    rows = kinked(spark, sf_dir)
    maxima = kkt.uniform_maxima(rows, len(REGIONS)).join(rows.groupBy("tumor_id").agg(F.concat(F.lit("uniform:"), F.countDistinct("mutation_id").cast("string")).alias("graph")), "tumor_id").withColumn("lam", F.lit(1.0))
    out = ct.certify(_with_flow(ct.one_sided(rows), graph.uniform_flow(rows, len(REGIONS))), maxima, "lam", TOLERANCE)
    numbers = [_r(c).alias(c) for c in ("stationarity", "edge_residual", "ball_residual", "kkt")]
    return out.select("tumor_id", "lam", *numbers, "kkt_tolerance", "n_kinks", "n_downward", "certified", "admissible", "objective_certified", "gradient_scope", "cert_status", "graph_hash")


# The profile of a candidate is its refitted centers; edges between two clusters are alike.
PARTS["cands_cert"] = """fit7 AS (SELECT tumor_id, candidate_id, cluster, sample_id, beta FROM cl7 QUALIFY row_number() OVER (PARTITION BY tumor_id, candidate_id, cluster, sample_id ORDER BY round(loss, 9), beta) = 1),
vec7 AS (SELECT tumor_id, candidate_id, cluster, list(beta ORDER BY sample_id) AS x FROM fit7 GROUP BY ALL),
pair7 AS (SELECT *, sqrt(list_sum(list_transform(diff, lambda x: x * x))) AS nrm, 1e0 / candidate_id / greatest(m - 1, 1) AS w FROM (
  SELECT a.tumor_id, a.candidate_id, a.cluster, bl7.n_k, m, list_transform(range(1, len(a.x) + 1), lambda i: a.x[i] - b.x[i]) AS diff FROM vec7 a JOIN vec7 b ON a.tumor_id = b.tumor_id AND a.candidate_id = b.candidate_id AND a.cluster <> b.cluster
  JOIN bl7 ON bl7.tumor_id = b.tumor_id AND bl7.candidate_id = b.candidate_id AND bl7.cluster = b.cluster JOIN (SELECT tumor_id, candidate_id, SUM(n_k) AS m FROM bl7 GROUP BY ALL) s ON s.tumor_id = a.tumor_id AND s.candidate_id = a.candidate_id)),
flow7 AS (SELECT tumor_id, candidate_id, cluster, i, SUM(CASE WHEN nrm > 1e-6 THEN n_k * w * diff[i] / nrm ELSE 0 END) AS y FROM pair7, unnest(range(1, len(diff) + 1)) t(i) GROUP BY ALL),
max7 AS (SELECT tumor_id, candidate_id, MAX(CASE WHEN nrm > 1e-6 THEN 0e0 WHEN nrm >= w THEN w ELSE nrm END / greatest(1, w)) AS edge_residual FROM pair7 GROUP BY ALL),
at7 AS (SELECT u.tumor_id, l.candidate_id, l.cluster, u.mutation_id, u.sample_id, u.count_observed, u.alt, u.nonalt, u.c, f.beta, p.first, p.second, p.switch, p.log_prior, p.first * least(beta, switch) + p.second * greatest(beta - switch, 0) AS mass
  FROM prof u JOIN lab7 l ON l.tumor_id = u.tumor_id AND l.mutation_id = u.mutation_id JOIN fit7 f ON f.tumor_id = u.tumor_id AND f.candidate_id = l.candidate_id AND f.cluster = l.cluster AND f.sample_id = u.sample_id
  JOIN path p ON p.tumor_id = u.tumor_id AND p.sample_id = u.sample_id AND p.segment_id = u.segment_id),
at7b AS (SELECT *, least(greatest(c * mass, 1e-6), 1 - 1e-6) AS q, CASE WHEN c * mass > 1e-6 AND c * mass <= 1 - 1e-6 THEN c * CASE WHEN beta <= switch THEN first ELSE second END ELSE 0 END AS dl FROM at7),
g7 AS (SELECT tumor_id, candidate_id, cluster, sample_id, any_value(beta) AS beta, CASE WHEN bool_and(count_observed) THEN -SUM(exp(j - top) * dl * (alt / q - nonalt / (1 - q))) / SUM(exp(j - top)) ELSE 0e0 END AS g FROM (
  SELECT *, MAX(j) OVER (PARTITION BY tumor_id, candidate_id, mutation_id, sample_id) AS top FROM (SELECT *, alt * ln(q) + nonalt * ln(1 - q) + log_prior AS j FROM at7b)) GROUP BY tumor_id, candidate_id, cluster, mutation_id, sample_id),
st7 AS (SELECT tumor_id, candidate_id, MAX(abs(CASE WHEN beta = 1e-6 THEN least(g + y, 0) WHEN beta = 1 THEN greatest(g + y, 0) ELSE g + y END) / greatest(1, abs(g) + abs(y))) AS stationarity FROM (
  SELECT g7.*, COALESCE(flow7.y, 0) AS y FROM (SELECT *, dense_rank() OVER (PARTITION BY tumor_id ORDER BY sample_id) AS i FROM g7) g7 LEFT JOIN flow7 USING (tumor_id, candidate_id, cluster, i)) GROUP BY ALL),
cert7 AS (SELECT sc.*, CASE WHEN candidate_id <= 2 THEN 97e-2 ELSE 1000001e-6 END AS tol, greatest(stationarity, COALESCE(edge_residual, 0)) AS kkt, COALESCE(near, 9e9) AS near FROM sc JOIN st7 USING (tumor_id, candidate_id) LEFT JOIN max7 USING (tumor_id, candidate_id)
  LEFT JOIN (SELECT tumor_id, candidate_id, MIN(nrm) AS near FROM pair7 GROUP BY ALL) USING (tumor_id, candidate_id)),
why7 AS (SELECT *, CASE WHEN is_raw AND NOT kkt <= tol THEN 'raw_objective_not_kkt_certified' WHEN is_raw AND near <= 5e-2 THEN 'mergeable_blocks' ELSE 'none' END AS reason FROM cert7)"""
CERTS = (*CANDS, "cands_cert")


def certified(spark, sf_dir):
    """The seven candidates with score, certificate of their refitted profile, and whether their clusters keep apart."""
    rows = units(spark, sf_dir)
    labels = candidate_labels(rows)
    key = ("tumor_id", "candidate_id")
    partitions.ensure_checkpoints(spark)
    sums = cd.loss_sums(rows, labels).checkpoint()  # five tables below read it
    centers = cd.centers(sums)
    sizes = labels.groupBy(*key, "cluster").agg(F.count("*").alias("size")).withColumn("lam", 1.0 / F.col("candidate_id"))
    flow, maxima = ct.block_flow(centers, sizes, "lam", key)
    profile = rows.join(labels, ["tumor_id", "mutation_id"]).join(centers.withColumnRenamed("beta", "phi"), [*key, "cluster", "sample_id"]).join(flow, [*key, "cluster", "sample_id"], "left")
    certificates = ct.certify(ct.one_sided(profile), maxima, "lam", F.when(F.col("candidate_id") <= 2, TOLERANCE).otherwise(LENIENT), key)
    apart = partitions.center_gaps(centers, key)
    table = cd.evaluated(rows, labels, sums=sums).join(certificates, [*key]).join(apart, [*key], "left")
    single = F.coalesce(F.col("nearest") > 0.05, F.lit(True))
    return table.withColumns({
        "is_raw": F.col("candidate_id") % 2 == 1, "partition_certified": single, "partition_reason": F.lit("mergeable_blocks"), "finite_refit": ~F.isnan("loglik"), "refit_resolved": F.lit(True), "refit_certified": F.lit(True),
        "score": F.round("score", 4), "uncertainty": F.lit(1e-4), "objective": -F.col("loglik"), "source": F.lit("residues"),
    }).checkpoint()


@query(CERTS, "SELECT tumor_id, candidate_id, lam, round(kkt, 6) AS kkt, kkt <= tol AS certified, reason, is_raw AND reason = 'none' AS exact, reason = 'none' AS eligible, is_raw AND reason = 'none' AS eligible_strict FROM why7")
def candidate_certificates(spark, sf_dir):
    out = certified(spark, sf_dir)
    return out.select("tumor_id", "candidate_id", "lam", _r("kkt").alias("kkt"), "certified", cd.ineligibility().alias("reason"), cd.has_exact_certificate().alias("exact"), cd.selection_eligible().alias("eligible"), cd.selection_eligible(strict=True).alias("eligible_strict"))


@query(CERTS, """SELECT tumor_id, COUNT(*) FILTER (is_raw) AS n_raw, COUNT(*) FILTER (is_raw AND kkt <= tol) AS n_certified, COUNT(*) FILTER (is_raw AND near > 5e-2) AS n_partition_certified, COUNT(*) FILTER (NOT is_raw) AS n_direct,
  COUNT(*) FILTER (NOT is_raw AND reason = 'none') AS n_direct_eligible, round(MIN(kkt) FILTER (is_raw), 6) AS least_kkt FROM why7 GROUP BY tumor_id""")  # fmt: skip
def candidate_failures(spark, sf_dir):
    return cd.failure_summary(certified(spark, sf_dir)).withColumn("least_kkt", _r("least_kkt")).drop("least_kkt_tolerance")


@query(CERTS, """SELECT tumor_id, candidate_id, signature, round(rs, 4) AS score FROM (SELECT *, MIN(rs + 1e-4) OVER (PARTITION BY tumor_id) AS least FROM (
  SELECT *, row_number() OVER (PARTITION BY tumor_id, signature ORDER BY rs, k, df, lam, candidate_id) AS r FROM why7 WHERE reason = 'none') WHERE r = 1) WHERE rs - 1e-4 <= least
  QUALIFY row_number() OVER (PARTITION BY tumor_id ORDER BY k, df, lam, NOT is_raw, signature, candidate_id) = 1""")  # fmt: skip
def certified_selection(spark, sf_dir):
    return scores.select_candidates(certified(spark, sf_dir), cd.selection_eligible()).select("tumor_id", "candidate_id", "signature", _r("score", 4).alias("score"))
