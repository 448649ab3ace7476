"""Fits a cohort: long table to units, one search for each tumor in parallel, result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import copynumber, kernels, partitions, paths
from tessera.plans import report
from tessera.plans.config import FitConfig


def prepared(long: DataFrame, config: FitConfig = FitConfig()) -> DataFrame:
    """Units with the paths of their tumor's route. With ``unsupported="error"`` units without paths raise."""
    units = copynumber.units(long)
    if config.unsupported == "error":
        bad = units.filter("unsupported_reason IS NOT NULL").select("tumor_id", "sample_id", "segment_id", "unsupported_reason").limit(1).collect()
        if bad:
            raise ValueError(f"{bad[0].tumor_id}, {bad[0].sample_id}, segment {bad[0].segment_id}: {bad[0].unsupported_reason}")
    units = paths.with_paths(units, config.dosage_penalty)
    return units.withColumn("paths", F.when(F.col("path_route"), F.col("paths")).otherwise(paths.legacy_paths(config.major_prior)))


def fit_cohort(long: DataFrame, config: FitConfig = FitConfig()) -> dict[str, DataFrame]:
    """mutation_clusters, cluster_centers, mutation_region_multiplicity and summary of every tumor.

    The models are written once, since all four tables read them: as a checkpoint in ``spark.checkpoint.dir``, which a cluster
    must name; in local mode a folder is made where it is unset.
    """
    units = prepared(long, config)
    options = {"tolerance": config.partition_tolerance, "explore": config.explore, "refine": config.refine, "kkt_tolerance": config.kkt_tolerance, "code_weight": config.code_weight}
    partitions.ensure_checkpoints(long.sparkSession)
    models = kernels.selected_models(units, **options).checkpoint()
    labels = models.select("tumor_id", "mutation_id", "cluster").distinct()
    centers = models.select("tumor_id", "cluster", "sample_id", F.col("phi").alias("beta")).distinct()
    regions = sorted(r.sample_id for r in units.select("sample_id").distinct().collect())  # columns of the wide tables
    summary = models.groupBy("tumor_id").agg(F.first("score").alias("score"), F.first("lam").alias("lam"), F.first("family").alias("family"), F.first("kkt").alias("kkt"), F.first("n_clusters").alias("n_clusters"), F.countDistinct("mutation_id").alias("n_mutations"))
    return {
        "mutation_clusters": report.mutation_clusters(labels, centers, regions), "cluster_centers": report.cluster_centers(labels, centers, regions),
        "mutation_region_multiplicity": report.mutation_regions(units, labels, centers, config.major_prior), "summary": summary,
    }
