"""Result tables of a fitted cohort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import likelihood as L
from tessera.functions.special import finite_or_null
from tessera.operators import paths, scores


def _wide(centers: DataFrame, regions: list[str]) -> DataFrame:
    """Centers with one column for each region; the regions are named, so no job looks for them."""
    return centers.groupBy("tumor_id", "cluster").pivot("sample_id", regions).agg(F.first("beta")).select("tumor_id", "cluster", *[F.col(r).alias(f"phi_{r}") for r in regions])


def mutation_clusters(labels: DataFrame, centers: DataFrame, regions: list[str]) -> DataFrame:
    """tumor_id, mutation_id, cluster_label (from 1) and the cluster's phi in each region."""
    out = labels.join(_wide(centers, regions), ["tumor_id", "cluster"])
    return out.select("tumor_id", "mutation_id", (F.col("cluster") + 1).alias("cluster_label"), *[f"phi_{r}" for r in regions])


def cluster_centers(labels: DataFrame, centers: DataFrame, regions: list[str]) -> DataFrame:
    """tumor_id, cluster_label, cluster_size and phi in each region."""
    sizes = labels.groupBy("tumor_id", "cluster").agg(F.count("*").alias("cluster_size"))
    out = sizes.join(_wide(centers, regions), ["tumor_id", "cluster"])
    return out.select("tumor_id", (F.col("cluster") + 1).alias("cluster_label"), "cluster_size", *[f"phi_{r}" for r in regions])


def mutation_regions(units: DataFrame, labels: DataFrame, centers: DataFrame, major_prior: float = 0.5) -> DataFrame:
    """One row for each mutation and region: cluster, phi, copy numbers, and multiplicity (tumors of one-state segments) or the
    summary of the path posterior at phi (the others)."""
    rows = units.join(labels.select("tumor_id", "mutation_id", "cluster"), ["tumor_id", "mutation_id"])
    rows = rows.join(centers.select("tumor_id", "cluster", "sample_id", F.col("beta").alias("phi")), ["tumor_id", "cluster", "sample_id"])
    rows = rows.withColumn("paths", F.when(F.col("path_route"), F.col("paths")).otherwise(paths.legacy_paths(major_prior)))
    rows = rows.withColumn("terms", L.log_terms()).withColumn("post", L.posterior())
    gamma = F.when(F.col("multiplicity_estimated"), F.element_at("post", -1)).otherwise(F.lit(1.0))
    call = F.when(gamma >= 0.5, F.col("major_cn")).otherwise(F.col("multiplicity_low"))
    route, ok = F.col("path_route"), F.col("unsupported_reason").isNull()
    legacy = {"gamma_major": gamma, "major_call": gamma >= 0.5, "multiplicity_call": call}
    return rows.select(
        "tumor_id", "mutation_id", F.col("sample_id").alias("region_id"), (F.col("cluster") + 1).alias("cluster_label"), "phi", "major_cn", "minor_cn", F.when(~route, F.col("multiplicity_estimated")).alias("multiplicity_estimated"),
        *[F.when(~route, v).alias(k) for k, v in legacy.items()], *[F.when(route & ok, v).alias(k) for k, v in L.path_summary().items()], F.when(route, ok).alias("path_supported"), F.col("unsupported_reason").alias("path_unsupported_reason"),
    )


def summary(candidates: DataFrame, weight: float = scores.WEIGHT, alpha: float = 1.0) -> DataFrame:
    """One row a tumor about its selected candidate, from candidates with their scores: of each signature the first, of these the
    best score, then fewest clusters. Numbers that aren't finite are null. The penalty path is bounded, so no selection is
    ever proved best."""
    n = candidates.groupBy("tumor_id").agg(F.count("*").alias("num_candidates"), F.count_if("is_raw").alias("num_candidates_raw"))
    rows = candidates.withColumn("_s", F.round("score", 4))
    best = scores.best_per(scores.best_per(rows, ["tumor_id", "signature"], ["_s", "candidate_id"]), ["tumor_id"], ["_s", "k", "candidate_id"]).join(n, "tumor_id")
    mass = F.col("log_mass")
    return best.select(
        "tumor_id", F.lit("provisional_unresolved").alias("selection_status"), F.col("candidate_id").alias("selected_candidate_id"), F.when(F.col("is_raw"), "raw_fusion").otherwise("direct_partition").alias("selected_candidate_family"),
        finite_or_null("lam").alias("selected_lambda"), F.col("k").alias("selected_n_clusters"), F.col("signature").alias("selected_partition_signature"), F.lit("fixed_partition_dirichlet_score").alias("selection_score_name"),
        finite_or_null("score").alias("selection_score"), finite_or_null("loglik").alias("selection_loglik"), F.col("df").alias("selection_df"), F.col("n_eff").alias("selection_n_eff"),
        finite_or_null("penalty").alias("selection_penalty"), finite_or_null(mass).alias("selection_assignment_log_evidence"), F.lit(float(weight)).alias("selection_assignment_code_weight"),
        finite_or_null(-2.0 * weight * mass).alias("selection_assignment_penalty"), F.lit(float(alpha)).alias("selection_assignment_dirichlet_alpha"), finite_or_null("kkt").alias("selected_kkt_residual"), "num_candidates", "num_candidates_raw",
    )


def write_tables(tables: dict[str, DataFrame], outdir: str) -> None:
    """Result tables as tab-separated files below ``outdir``, one folder for each tumor; missing values as points."""
    for name, table in tables.items():
        table.repartition("tumor_id").write.partitionBy("tumor_id").option("sep", "\t").option("header", True).option("nullValue", ".").mode("overwrite").csv(f"{outdir}/{name}")


def write_results(outdir: str, labels: DataFrame, centers: DataFrame, units: DataFrame, regions: list[str], major_prior: float = 0.5) -> None:
    """The three result tables of given labels and centers, written as ``write_tables`` does."""
    regional = mutation_regions(units, labels, centers, major_prior)
    write_tables({"mutation_clusters": mutation_clusters(labels, centers, regions), "cluster_centers": cluster_centers(labels, centers, regions), "mutation_region_multiplicity": regional}, outdir)
