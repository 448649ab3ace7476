"""Queries over many partitions of each tumor, over the penalty path that they stand for, and over certificates.

Real candidates: seven partitions of each tumor's mutations (by residues, the last one the fourth with other labels), refitted
and scored by the engine. Certificates come from a made-up table with every field of the admission contract.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.special import finite_or_null
from tessera.operators import candidates as cd
from tessera.operators import scores
from tessera.plans.cohort import FIT_SQL, PARTS, _r, cohort_labels, query, units

N_CANDIDATES = 7

PARTS["cands"] = """lab7 AS (SELECT tumor_id, CAST(g AS INT) AS candidate_id, mutation_id, CASE WHEN g = 7 THEN (mutation_id * 3) % 4 ELSE mutation_id % g END AS cluster
  FROM (SELECT DISTINCT tumor_id, mutation_id FROM prof), range(1, 8) r(g)),
cl7 AS (SELECT l.tumor_id, l.candidate_id, l.cluster, gl.sample_id, beta, SUM(loss) AS loss FROM gl JOIN lab7 l ON l.tumor_id = gl.tumor_id AND l.mutation_id = gl.mutation_id GROUP BY ALL),
ll7 AS (SELECT tumor_id, candidate_id, -SUM(loss) AS loglik FROM (SELECT tumor_id, candidate_id, cluster, sample_id, MIN(loss) AS loss FROM cl7 GROUP BY ALL) GROUP BY ALL),
bl7 AS (SELECT tumor_id, candidate_id, cluster, COUNT(*) AS n_k, sha256(string_agg(CAST(mutation_id AS VARCHAR), ',' ORDER BY mutation_id)) AS block FROM lab7 GROUP BY ALL),
sg7 AS (SELECT tumor_id, candidate_id, COUNT(*) AS k, COUNT(*) || ':' || sha256(string_agg(block, ';' ORDER BY block)) AS signature,
  lgamma(COUNT(*) + 1e0) + lgamma(CAST(COUNT(*) AS DOUBLE)) + SUM(lgamma(n_k + 1e0)) - lgamma(CAST(SUM(n_k) + COUNT(*) AS DOUBLE)) AS log_mass FROM bl7 GROUP BY ALL),
ne AS (SELECT tumor_id, greatest(COUNT(*) FILTER (count_observed AND alt + nonalt > 0), 1) AS n_eff, COUNT(DISTINCT sample_id) AS n_regions FROM unit GROUP BY tumor_id),
sc0 AS (SELECT tumor_id, candidate_id, k, signature, k * n_regions AS df, n_eff, loglik, -2 * loglik + k * n_regions * ln(CAST(n_eff AS DOUBLE)) AS bic, log_mass FROM sg7 JOIN ll7 USING (tumor_id, candidate_id) JOIN ne USING (tumor_id)),
sc AS (SELECT *, bic - 14e-1 * log_mass AS score, 1e0 / candidate_id AS lam, candidate_id % 2 = 1 AS is_raw, candidate_id - 1 AS parent_id, round(bic - 14e-1 * log_mass, 4) AS rs FROM sc0)"""
CANDS = (*FIT_SQL, "grid", "cands")


def candidate_labels(rows: DataFrame) -> DataFrame:
    """(tumor_id, candidate_id, mutation_id, cluster) of the real candidates."""
    every = rows.select("tumor_id", "mutation_id").distinct().withColumn("candidate_id", F.explode(F.sequence(F.lit(1), F.lit(N_CANDIDATES))))
    m, g = F.col("mutation_id"), F.col("candidate_id")
    return every.select("tumor_id", "candidate_id", "mutation_id", F.when(g == N_CANDIDATES, (m * 3) % 4).otherwise(m % g).cast("int").alias("cluster"))


def scored(spark, sf_dir) -> DataFrame:
    rows = units(spark, sf_dir)
    out = cd.evaluated(rows, candidate_labels(rows))
    g = F.col("candidate_id")
    out = out.withColumns({"lam": 1.0 / g, "is_raw": g % 2 == 1, "parent_id": g - 1})
    return out.withColumn("score", F.round("score", 4))


@query(CANDS, """SELECT tumor_id, candidate_id, k, signature, CAST(df AS BIGINT) AS df, n_eff, round(loglik, 3) AS loglik, round(bic, 3) AS bic, round(log_mass, 5) AS log_mass, round(score, 3) AS score FROM sc""")
def partition_scores(spark, sf_dir):
    out = scored(spark, sf_dir)
    return out.select("tumor_id", "candidate_id", "k", "signature", "df", "n_eff", _r("loglik", 3).alias("loglik"), _r("bic", 3).alias("bic"), _r("log_mass", 5).alias("log_mass"), _r(F.col("bic") - 2 * scores.WEIGHT * F.col("log_mass"), 3).alias("score"))


@query(CANDS, """SELECT tumor_id, candidate_id, k, signature, round(rs, 3) AS score FROM (SELECT *, row_number() OVER (PARTITION BY tumor_id, signature ORDER BY rs, candidate_id) AS r FROM sc) WHERE r = 1
  QUALIFY row_number() OVER (PARTITION BY tumor_id ORDER BY rs, k, lam, NOT is_raw, candidate_id) = 1""")  # fmt: skip
def selected_partition(spark, sf_dir):
    rep = scores.best_per(scored(spark, sf_dir), ["tumor_id", "signature"], ["score", "candidate_id"]).withColumn("not_raw", (~F.col("is_raw")).cast("int"))
    return scores.best_per(rep, ["tumor_id"], ["score", "k", "lam", "not_raw", "candidate_id"]).select("tumor_id", "candidate_id", "k", "signature", _r("score", 3).alias("score"))


@query(CANDS, "SELECT tumor_id, signature, COUNT(*) AS n, TRUE AS consistent FROM sc GROUP BY ALL")
def signature_consistency(spark, sf_dir):
    return cd.inconsistent(scored(spark, sf_dir), 1e-6).select("tumor_id", "signature", "n", "consistent")


@query(CANDS, "SELECT tumor_id, candidate_id, signature FROM sc WHERE CAST(split_part(signature, ':', 1) AS BIGINT) <> k")
def misidentified_candidates(spark, sf_dir):
    rows = units(spark, sf_dir)
    return cd.misidentified(cd.evaluated(rows, candidate_labels(rows))).select("tumor_id", "candidate_id", "signature")


@query(CANDS, "SELECT c.tumor_id, c.candidate_id, p.signature AS parent_signature, round(p.lam, 6) AS parent_lam FROM sc c LEFT JOIN sc p ON p.tumor_id = c.tumor_id AND p.candidate_id = c.parent_id")
def candidate_parents(spark, sf_dir):
    return cd.with_parents(scored(spark, sf_dir)).select("tumor_id", "candidate_id", "parent_signature", _r("parent_lam").alias("parent_lam"))


_ORDERED = "SELECT *, lead(lam) OVER (PARTITION BY tumor_id ORDER BY lam) AS next_lam, lead(signature) OVER (PARTITION BY tumor_id ORDER BY lam) AS next_signature FROM sc"


@query(CANDS, f"""SELECT tumor_id, round(lam, 6) AS lam_low, round(next_lam, 6) AS lam_high, round(log10(next_lam / lam), 6) AS log10_width, round(sqrt(lam * next_lam), 6) AS middle, log10(next_lam / lam) > 6e-2 AS unresolved
  FROM ({_ORDERED}) WHERE next_lam IS NOT NULL AND next_signature <> signature""")  # fmt: skip
def lambda_path_events(spark, sf_dir):
    out = cd.path_events(scored(spark, sf_dir), 0.06)
    return out.select("tumor_id", *[_r(c).alias(c) for c in ("lam_low", "lam_high", "log10_width", "middle")], "unresolved")


@query(CANDS, """SELECT tumor_id, round(MIN(lam) FILTER (signature = best), 6) AS best_lam_min, round(MAX(lam) FILTER (signature = best), 6) AS best_lam_max, MIN(lam) FILTER (signature = best) = MIN(lam) AS hits_lower,
  MAX(lam) FILTER (signature = best) = MAX(lam) AS hits_upper FROM (SELECT *, first_value(signature) OVER (PARTITION BY tumor_id ORDER BY rs, lam) AS best FROM sc) GROUP BY tumor_id""")  # fmt: skip
def lambda_boundary(spark, sf_dir):
    out = cd.boundary_flags(scored(spark, sf_dir))
    return out.select("tumor_id", _r("best_lam_min").alias("best_lam_min"), _r("best_lam_max").alias("best_lam_max"), "hits_lower", "hits_upper")


@query(CANDS, "SELECT tumor_id, candidate_id, k FROM sc WHERE is_raw QUALIFY row_number() OVER (PARTITION BY tumor_id ORDER BY rs, lam, candidate_id) <= 2")
def final_parents(spark, sf_dir):
    return cd.final_parents(scored(spark, sf_dir), 2).select("tumor_id", "candidate_id", "k")


@query(CANDS, """SELECT * EXCLUDE (rs) FROM (SELECT tumor_id, 'provisional_unresolved' AS selection_status, candidate_id AS selected_candidate_id, CASE WHEN is_raw THEN 'raw_fusion' ELSE 'direct_partition' END AS selected_candidate_family,
  round(lam, 6) AS selected_lambda, k AS selected_n_clusters, signature AS selected_partition_signature, 'fixed_partition_dirichlet_score' AS selection_score_name, round(score, 3) AS selection_score, round(loglik, 3) AS selection_loglik,
  CAST(df AS BIGINT) AS selection_df, n_eff AS selection_n_eff, round(-14e-1 * log_mass + df * ln(CAST(n_eff AS DOUBLE)), 3) AS selection_penalty, round(log_mass, 5) AS selection_assignment_log_evidence,
  7e-1 AS selection_assignment_code_weight, round(-14e-1 * log_mass, 4) AS selection_assignment_penalty, 1e0 AS selection_assignment_dirichlet_alpha, CAST(NULL AS DOUBLE) AS selected_kkt_residual,
  COUNT(*) OVER (PARTITION BY tumor_id) AS num_candidates, COUNT(*) FILTER (is_raw) OVER (PARTITION BY tumor_id) AS num_candidates_raw, rs FROM sc)
  QUALIFY row_number() OVER (PARTITION BY tumor_id ORDER BY rs, selected_n_clusters, selected_candidate_id) = 1""")  # fmt: skip
def fit_summary(spark, sf_dir):
    from tessera.plans import report

    rows = units(spark, sf_dir)
    table = cd.evaluated(rows, candidate_labels(rows)).withColumns({"lam": 1.0 / F.col("candidate_id"), "is_raw": F.col("candidate_id") % 2 == 1, "kkt": F.lit(float("nan"))})
    out = report.summary(table)
    digits = {"selected_lambda": 6, "selection_score": 3, "selection_loglik": 3, "selection_penalty": 3, "selection_assignment_log_evidence": 5, "selection_assignment_penalty": 4}
    return out.withColumns({c: _r(c, n) for c, n in digits.items()})


@query((*FIT_SQL,), """SELECT tumor_id, k, n, round(lgamma(k + 1e0) + lgamma(k * 5e-1) + inner_ - lgamma(n + k * 5e-1), 5) AS log_mass FROM (
  SELECT tumor_id, COUNT(*) AS k, CAST(SUM(n_k) AS BIGINT) AS n, SUM(lgamma(n_k + 5e-1) - lgamma(5e-1)) AS inner_ FROM (SELECT tumor_id, cluster, COUNT(DISTINCT mutation_id) AS n_k FROM prof GROUP BY ALL) GROUP BY tumor_id)""")  # fmt: skip
def dirichlet_mass_alpha(spark, sf_dir):
    sizes = scores.cluster_sizes(cohort_labels(spark, sf_dir))
    return scores.partition_log_mass(sizes, 0.5).select("tumor_id", "k", "n", _r("log_mass", 5).alias("log_mass"))


# --- certificates ------------------------------------------------------------------------------------------------------------
PARTS["cert"] = """cert AS (SELECT 'T' || (s_suppkey % 5) AS tumor_id, s_suppkey AS candidate_id, s_suppkey % 3 <> 0 AS is_raw, CAST((s_suppkey * 13) % 17 AS DOUBLE) / 10 AS lam, s_suppkey % 11 <> 0 AS certified, s_suppkey % 19 <> 0 AS admissible,
  s_suppkey % 13 <> 0 AS objective_certified, s_suppkey % 7 <> 0 AS partition_certified, 'diameter' AS partition_reason, CAST(s_suppkey % 6 AS BIGINT) AS k, s_suppkey % 9 <> 0 AS finite_refit, s_suppkey % 8 <> 0 AS refit_resolved, s_suppkey % 10 <> 0 AS refit_certified,
  CASE WHEN s_suppkey % 23 = 0 THEN CAST('nan' AS DOUBLE) ELSE CAST((s_suppkey * 37) % 41 AS DOUBLE) END AS score, 1e-1 AS uncertainty, CAST((s_suppkey * 11) % 23 AS DOUBLE) AS objective, CASE WHEN s_suppkey % 12 = 0 THEN 1e-2 ELSE 1e-5 * (s_suppkey % 50) END AS kkt,
  1e-3 AS kkt_tolerance, CASE WHEN s_suppkey % 29 = 0 THEN 1 ELSE 2 END AS cert_schema, CASE s_suppkey % 4 WHEN 0 THEN 'certified' WHEN 1 THEN 'refined_fused_edge_dual' WHEN 2 THEN 'analytic_nonfused_dual' ELSE 'budget' END AS cert_status, 'p' || (s_suppkey % 3) AS source FROM supplier),
reason AS (SELECT *, CASE WHEN is_raw AND lam <= 0 THEN 'nonpositive_lambda' WHEN is_raw AND NOT (certified AND admissible) THEN 'raw_objective_not_kkt_certified' WHEN is_raw AND NOT partition_certified THEN partition_reason
  WHEN NOT is_raw AND k < 1 THEN 'empty_partition' WHEN NOT finite_refit THEN 'fixed_partition_refit_nonfinite' WHEN NOT (CASE WHEN is_raw THEN refit_resolved ELSE refit_certified END) THEN 'fixed_partition_refit_numerically_unresolved'
  WHEN isnan(score) THEN 'fixed_partition_score_nonfinite' ELSE 'none' END AS reason FROM cert),
exact AS (SELECT *, is_raw AND reason = 'none' AND objective_certified AND cert_schema = 2 AND cert_status <> 'budget' AND kkt <= kkt_tolerance AS exact FROM reason)"""


def certificates(spark, sf_dir) -> DataFrame:
    s, x = spark.read.parquet(f"{sf_dir}/supplier.parquet"), F.col("s_suppkey")
    status = F.element_at(F.array(*[F.lit(v) for v in ("certified", "refined_fused_edge_dual", "analytic_nonfused_dual", "budget")]), (x % 4 + 1).cast("int"))
    text = {"cert_method": cd.EXACT["method"], "cert_dtype": cd.EXACT["dtype"], "cert_scope": cd.EXACT["scope"], "gradient_scope": cd.GRADIENT_SCOPES[0], "objective_hash": "o", "graph_hash": "g", "problem_hash": "p", "partition_reason": "diameter"}
    return s.select(
        F.concat(F.lit("T"), (x % 5).cast("string")).alias("tumor_id"), x.alias("candidate_id"), (x % 3 != 0).alias("is_raw"), (((x * 13) % 17).cast("double") / 10).alias("lam"), (x % 11 != 0).alias("certified"), (x % 19 != 0).alias("admissible"),
        (x % 13 != 0).alias("objective_certified"), (x % 7 != 0).alias("partition_certified"), (x % 6).alias("k"), (x % 9 != 0).alias("finite_refit"), (x % 8 != 0).alias("refit_resolved"), (x % 10 != 0).alias("refit_certified"),
        F.when(x % 23 == 0, float("nan")).otherwise(((x * 37) % 41).cast("double")).alias("score"), F.lit(0.1).alias("uncertainty"), ((x * 11) % 23).cast("double").alias("objective"), F.when(x % 12 == 0, 1e-2).otherwise(1e-5 * (x % 50)).alias("kkt"),
        F.lit(1e-3).alias("kkt_tolerance"), F.when(x % 29 == 0, 1).otherwise(2).alias("cert_schema"), status.alias("cert_status"), F.concat(F.lit("p"), (x % 3).cast("string")).alias("source"), *[F.lit(v).alias(c) for c, v in text.items()],
    )


@query(("cert",), "SELECT tumor_id, candidate_id, reason, exact, CASE WHEN is_raw THEN exact ELSE reason = 'none' END AS eligible, CASE WHEN is_raw THEN exact ELSE FALSE END AS eligible_strict FROM exact")
def certificate_admission(spark, sf_dir):
    return certificates(spark, sf_dir).select("tumor_id", "candidate_id", cd.ineligibility().alias("reason"), cd.has_exact_certificate().alias("exact"), cd.selection_eligible().alias("eligible"), cd.selection_eligible(strict=True).alias("eligible_strict"))


@query(("cert",), "SELECT tumor_id, reason, COUNT(*) AS n FROM (SELECT tumor_id, reason FROM reason UNION ALL SELECT tumor_id, '<missing>' FROM reason WHERE candidate_id % 5 = 0) GROUP BY ALL")
def ineligibility_counts(spark, sf_dir):
    rows = certificates(spark, sf_dir).withColumn("reason", cd.ineligibility())
    return cd.reason_counts(rows.select("tumor_id", "reason").union(rows.filter("candidate_id % 5 = 0").select("tumor_id", F.lit(None).cast("string"))))


@query(("cert",), "SELECT tumor_id, candidate_id FROM exact WHERE exact QUALIFY row_number() OVER (PARTITION BY tumor_id ORDER BY score, uncertainty, lam, objective, candidate_id) = 1")
def raw_reference(spark, sf_dir):
    return cd.raw_reference(certificates(spark, sf_dir)).select("tumor_id", "candidate_id")


@query(("cert",), """SELECT tumor_id, k, candidate_id FROM cert QUALIFY row_number() OVER (PARTITION BY tumor_id, k ORDER BY NOT certified, objective, kkt, source, candidate_id) = 1""")
def best_start_attempt(spark, sf_dir):
    rows = certificates(spark, sf_dir).withColumn("source", F.concat("source", F.format_string("%09d", "candidate_id")))
    return cd.best_start(rows, ["tumor_id", "k"]).select("tumor_id", "k", "candidate_id")


@query(("cert",), """SELECT tumor_id, COUNT(*) FILTER (is_raw) AS n_raw, COUNT(*) FILTER (is_raw AND objective_certified) AS n_certified, COUNT(*) FILTER (is_raw AND partition_certified) AS n_partition_certified, COUNT(*) FILTER (NOT is_raw) AS n_direct,
  COUNT(*) FILTER (NOT is_raw AND reason = 'none') AS n_direct_eligible, round(MIN(kkt) FILTER (is_raw), 9) AS least_kkt, 1e-3 AS least_kkt_tolerance FROM reason GROUP BY tumor_id""")  # fmt: skip
def failure_summary(spark, sf_dir):
    return cd.failure_summary(certificates(spark, sf_dir)).withColumn("least_kkt", _r("least_kkt", 9))


@query(("cert",), """SELECT candidate_id, CASE WHEN isnan(score) THEN NULL ELSE score END AS score, (CASE WHEN candidate_id % 2 = 0 THEN 'pilot' ELSE 'final_phi' END) || '_hessian_ward' || CASE WHEN is_raw THEN '_cem' || CASE WHEN NOT admissible THEN '_component_death' ELSE '' END ELSE '' END AS source_name,
  array_to_string(list_distinct_ordered, ';') AS reasons FROM (SELECT *, CASE WHEN source = cert_status THEN [source] WHEN k < 1 THEN [source, cert_status] ELSE [cert_status] END AS list_distinct_ordered FROM cert)""")  # fmt: skip
def provenance_texts(spark, sf_dir):
    rows = certificates(spark, sf_dir)
    first = F.when(F.col("k") < 1, F.concat(F.lit(" "), F.col("source"))).otherwise(F.lit("  "))
    return rows.select(
        "candidate_id", finite_or_null("score").alias("score"), cd.direct_source(F.when(F.col("candidate_id") % 2 == 0, "pilot").otherwise("final"), F.col("is_raw"), ~F.col("admissible")).alias("source_name"),
        cd.joined_reasons(first, F.col("cert_status"), F.lit(None).cast("string"), F.col("cert_status")).alias("reasons"),
    )
