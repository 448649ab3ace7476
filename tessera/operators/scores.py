"""Scores of fixed partitions and the ranking of candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.special import log_factorial, log_gamma

WEIGHT = 0.7


def effective_counts(units: DataFrame) -> DataFrame:
    """(tumor_id, n_eff, depth, n_regions): observed units with reads, at least one; their reads; regions."""
    seen = F.col("observed") & (F.col("alt") + F.col("nonalt") > 0)
    return units.groupBy("tumor_id").agg(F.greatest(F.count_if(seen), F.lit(1)).alias("n_eff"), F.sum(F.when(seen, F.col("alt") + F.col("nonalt")).otherwise(0.0)).alias("depth"), F.countDistinct("sample_id").alias("n_regions"))


def cluster_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("tumor_id", "cluster").agg(F.count("*").alias("size"))


def partition_log_mass(sizes: DataFrame, alpha: float = 1.0) -> DataFrame:
    """(tumor_id, k, n, log_mass, log_mass_bound): Dirichlet mass of a partition with concentration ``alpha``, all labelings of it
    counted, and a bound on the rounding of its terms."""
    if not alpha > 0:
        raise ValueError("alpha must be positive")
    own = log_gamma(F.col("size") + alpha) - log_gamma(F.lit(alpha))
    out = sizes.groupBy("tumor_id").agg(F.count("*").alias("k"), F.sum("size").alias("n"), F.sum(own).alias("inner"), F.sum(F.abs(own)).alias("spread"))
    terms = [log_factorial("k"), log_gamma(F.col("k") * alpha), F.col("inner"), -log_gamma(F.col("n") + F.col("k") * alpha)]
    size = F.col("spread")
    for t in (terms[0], terms[1], terms[3]):
        size = size + F.abs(t)
    return out.select("tumor_id", "k", "n", (terms[0] + terms[1] + terms[2] + terms[3]).alias("log_mass"), (64 * 2.0**-52 * (F.col("k") + 4) * size).alias("log_mass_bound"))


def bic(counts: DataFrame, fits: DataFrame) -> DataFrame:
    """(tumor_id, loglik, k, df, n_eff, bic) from (tumor_id, loglik, k)."""
    df = F.col("k") * F.col("n_regions")
    return fits.join(counts, "tumor_id").select("tumor_id", "loglik", "k", df.alias("df"), "n_eff", (-2.0 * F.col("loglik") + df * F.ln(F.col("n_eff").cast("double"))).alias("bic"))


def dirichlet_score(counts: DataFrame, fits: DataFrame, sizes: DataFrame, weight: float = WEIGHT, alpha: float = 1.0) -> DataFrame:
    """BIC less twice the weighted log mass of the partition."""
    out = bic(counts, fits).join(partition_log_mass(sizes, alpha).select("tumor_id", "log_mass", "log_mass_bound"), "tumor_id")
    return out.withColumn("score", F.col("bic") - 2.0 * weight * F.col("log_mass"))


def canonical_labels(labels: DataFrame) -> DataFrame:
    """Labels numbered from 0 by each cluster's first mutation. Only one row a cluster is ranked."""
    first = labels.groupBy("tumor_id", "cluster").agg(F.min("mutation_id").alias("first"))
    rank = first.withColumn("canonical", (F.row_number().over(Window.partitionBy("tumor_id").orderBy("first")) - 1).cast("int"))
    return labels.join(rank.select("tumor_id", "cluster", "canonical"), ["tumor_id", "cluster"]).select("tumor_id", "mutation_id", F.col("canonical").alias("cluster"))


def signature(labels: DataFrame) -> DataFrame:
    """(tumor_id, signature): clusters and a digest of their blocks, the same however clusters are named. Blocks are digested
    first, so no row holds all mutations of a tumor."""
    block = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("mutation_id")), lambda m: m.cast("string")), ","), 256)
    blocks = labels.groupBy("tumor_id", "cluster").agg(block.alias("block"))
    return blocks.groupBy("tumor_id").agg(F.concat_ws(":", F.count("*").cast("string"), F.sha2(F.array_join(F.array_sort(F.collect_list("block")), ";"), 256)).alias("signature"))


def best_per(candidates: DataFrame, keys: list[str], order: list[str], n: int = 1) -> DataFrame:
    """The first n rows of each key by an order that leaves no ties."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return candidates.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def eligibility():
    """Why a candidate can't be chosen, the first reason that holds; null if it can."""
    return (
        F.when(F.col("score").isNull() | F.isnan("score"), "score_not_finite")
        .when(~F.col("finite_refit"), "refit_not_finite")
        .when(F.col("k") < 1, "empty_partition")
        .when(F.col("kkt") > F.col("kkt_tolerance"), "not_stationary")
    )


def select_candidates(candidates: DataFrame, eligible=None) -> DataFrame:
    """One candidate a tumor from (tumor_id, candidate_id, signature, score, uncertainty, k, df, lam, is_raw, objective, …).

    Of eligible candidates the first of each signature; of these the ones whose score interval reaches the least upper end;
    of those the simplest: fewest clusters, degrees of freedom, least lambda, raw fits first, then signature, objective, id.
    ``eligible`` replaces the conditions on residuals alone, as ``candidates.selection_eligible`` does where there are certificates.
    """
    ok = candidates.filter(eligibility().isNull() if eligible is None else eligible)
    rep = best_per(ok, ["tumor_id", "signature"], ["score", "k", "df", "lam", "objective", "candidate_id"])
    rep = rep.withColumns({"low": F.col("score") - F.col("uncertainty"), "high": F.col("score") + F.col("uncertainty")})
    least = rep.groupBy("tumor_id").agg(F.min("high").alias("least_high"))
    tied = rep.join(least, "tumor_id").filter("low <= least_high").withColumn("not_raw", (~F.col("is_raw")).cast("int"))
    return best_per(tied, ["tumor_id"], ["k", "df", "lam", "not_raw", "signature", "objective", "candidate_id"]).drop("low", "high", "least_high", "not_raw")
