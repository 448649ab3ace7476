"""Many partitions of a tumor at once: their refits and scores in one job, then eligibility, provenance and the penalty path.

A candidate is a partition with an id; tables of candidates are keyed by (tumor_id, candidate_id). All candidates of all tumors
go through one plan, so a wider search is more rows, not more jobs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.special import geometric_middle, log_factorial
from tessera.operators import refit, scores

KEY = ["tumor_id", "candidate_id"]
#: What a certificate must say.
EXACT = {"schema": 2, "method": "componentwise_box_cone_backward_error_v1", "dtype": "float64", "scope": "full_original_graph"}
GRADIENT_SCOPES = ("observed_objective", "clarke_piecewise_observed_objective_subgradient")
STATUSES = ("certified", "input_dual_retained", "analytic_nonfused_dual", "refined_fused_edge_dual", "zero_penalty_no_dual_needed")


def signatures(labels: DataFrame) -> DataFrame:
    """(tumor_id, candidate_id, k, signature) from (tumor_id, candidate_id, mutation_id, cluster): a digest of each block's sorted
    ids first, then of the sorted block digests, so no row holds more than one block."""
    block = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("mutation_id")), lambda m: m.cast("string")), ","), 256)
    blocks = labels.groupBy(*KEY, "cluster").agg(block.alias("block"))
    digest = F.sha2(F.array_join(F.array_sort(F.collect_list("block")), ";"), 256)
    return blocks.groupBy(*KEY).agg(F.count("*").alias("k"), F.concat_ws(":", F.count("*").cast("string"), digest).alias("signature"))


def loss_sums(units: DataFrame, labels: DataFrame, points: int = refit.GRID) -> DataFrame:
    """(tumor_id, candidate_id, cluster, sample_id, s0, s1, …): summed losses of every candidate's clusters on the grid. A unit's
    losses are computed once and summed for all candidates that its mutation belongs to."""
    losses = refit.unit_losses(units, points).join(labels, ["tumor_id", "mutation_id"])
    return losses.groupBy(*KEY, "cluster", "sample_id").agg(*[F.sum(F.get("losses", F.lit(i))).alias(f"s{i}") for i in range(points)])


def centers(sums: DataFrame, points: int = refit.GRID, decimals: int = 9) -> DataFrame:
    """(tumor_id, candidate_id, cluster, sample_id, beta): of ``loss_sums`` the center of least loss, then the least center."""
    at = F.arrays_zip(F.array(*[F.round(f"s{i}", decimals) for i in range(points)]).alias("loss"), refit.grid_column(points).alias("beta"))
    return sums.select(*KEY, "cluster", "sample_id", F.array_min(at)["beta"].alias("beta"))


def evaluated(units: DataFrame, labels: DataFrame, weight: float = scores.WEIGHT, points: int = refit.GRID, sums: DataFrame | None = None) -> DataFrame:
    """(tumor_id, candidate_id, k, signature, df, n_eff, loglik, bic, log_mass, penalty, score) of every candidate; ``sums`` are its
    ``loss_sums`` if there are some already."""
    sums = loss_sums(units, labels, points) if sums is None else sums
    key = [*KEY, "cluster", "sample_id"]
    least = sums.select(*key, F.array_min(F.array(*[f"s{i}" for i in range(points)])).alias("loss"))
    fits = least.groupBy(*KEY).agg((-F.sum("loss")).alias("loglik"))
    sizes = labels.groupBy(*KEY, "cluster").agg(F.count("*").alias("size")).groupBy(*KEY).agg(F.sum("size").alias("n"), F.sum(log_factorial("size")).alias("inner"))
    out = signatures(labels).join(fits, KEY).join(sizes, KEY).join(scores.effective_counts(units).select("tumor_id", "n_eff", "n_regions"), "tumor_id")
    k = F.col("k")
    mass = log_factorial("k") + log_factorial(k - 1) + F.col("inner") - log_factorial(F.col("n") + k - 1)
    df = k * F.col("n_regions")
    out = out.select(*KEY, "k", "signature", df.alias("df"), "n_eff", "loglik", (-2.0 * F.col("loglik") + df * F.ln(F.col("n_eff").cast("double"))).alias("bic"), mass.alias("log_mass"))
    out = out.withColumn("score", F.col("bic") - 2.0 * weight * F.col("log_mass"))
    return out.withColumn("penalty", F.col("score") + 2.0 * F.col("loglik"))


def inconsistent(scored: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """(tumor_id, signature, n, spread, consistent): candidates of one signature must have one score, whatever found them."""
    by = scored.groupBy("tumor_id", "signature").agg(F.count("*").alias("n"), (F.max("score") - F.min("score")).alias("spread"), F.max(F.abs("score")).alias("size"))
    return by.select("tumor_id", "signature", "n", "spread", (F.col("spread") <= tolerance * (1 + F.col("size"))).alias("consistent"))


def misidentified(scored: DataFrame, weight: float = scores.WEIGHT, tolerance: float = 1e-8) -> DataFrame:
    """Rows of ``scored`` whose stored score, penalty or number of clusters can't be derived again from their other columns."""
    penalty = F.col("df") * F.ln(F.col("n_eff").cast("double")) - 2.0 * weight * F.col("log_mass")
    size = tolerance * (1 + F.abs("score"))
    wrong = (F.abs(penalty - F.col("penalty")) > size) | (F.abs(-2.0 * F.col("loglik") + penalty - F.col("score")) > size) | (F.substring_index("signature", ":", 1).cast("long") != F.col("k"))
    return scored.filter(wrong)


def with_parents(scored: DataFrame) -> DataFrame:
    """Candidates with the signature and penalty weight of their parent candidate, null where they have none."""
    parents = scored.select("tumor_id", F.col("candidate_id").alias("parent_id"), F.col("signature").alias("parent_signature"), F.col("lam").alias("parent_lam"))
    return scored.join(parents, ["tumor_id", "parent_id"], "left")


def path_events(scored: DataFrame, width: float = 0.05) -> DataFrame:
    """(tumor_id, lam_low, lam_high, log10_width, middle, unresolved): neighbours on the penalty path with different partitions;
    an interval wider than ``width`` (decimal logarithms) is worth a fit at its geometric middle."""
    w = Window.partitionBy("tumor_id").orderBy("lam")
    rows = scored.withColumns({"next_lam": F.lead("lam").over(w), "next_signature": F.lead("signature").over(w)})
    rows = rows.filter(F.col("next_lam").isNotNull() & (F.col("signature") != F.col("next_signature")))
    size = F.log10(F.col("next_lam") / F.col("lam"))
    return rows.select("tumor_id", F.col("lam").alias("lam_low"), F.col("next_lam").alias("lam_high"), size.alias("log10_width"), geometric_middle(F.col("lam"), F.col("next_lam")).alias("middle"), (size > width).alias("unresolved"))


def boundary_flags(scored: DataFrame) -> DataFrame:
    """(tumor_id, best_lam_min, best_lam_max, hits_lower, hits_upper): whether the best partition's run on the penalty path reaches
    an end of what was tried."""
    best = scores.best_per(scored, ["tumor_id"], ["score", "lam"]).select("tumor_id", F.col("signature").alias("best"))
    rows = scored.join(best, "tumor_id")
    own = F.when(F.col("signature") == F.col("best"), F.col("lam"))
    out = rows.groupBy("tumor_id").agg(F.min(own).alias("best_lam_min"), F.max(own).alias("best_lam_max"), F.min("lam").alias("a"), F.max("lam").alias("b"))
    return out.select("tumor_id", "best_lam_min", "best_lam_max", (F.col("best_lam_min") == F.col("a")).alias("hits_lower"), (F.col("best_lam_max") == F.col("b")).alias("hits_upper"))


def reason_counts(rows: DataFrame, reason: str = "reason") -> DataFrame:
    """(tumor_id, reason, n), missing reasons as <missing>."""
    return rows.groupBy("tumor_id", F.coalesce(F.col(reason), F.lit("<missing>")).alias("reason")).agg(F.count("*").alias("n"))


def ineligibility() -> Column:
    """Why a candidate can't be selected: the first reason that holds, "none" if it can. Raw fits need a positive penalty, a
    certificate and a certified partition; direct partitions a cluster and a refit proved globally best."""
    raw = F.col("is_raw")
    resolved = F.when(raw, F.col("refit_resolved")).otherwise(F.col("refit_certified"))
    return (
        F.when(raw & (F.col("lam") <= 0), "nonpositive_lambda")
        .when(raw & ~(F.col("certified") & F.col("admissible")), "raw_objective_not_kkt_certified")
        .when(raw & ~F.col("partition_certified"), F.col("partition_reason"))
        .when(~raw & (F.col("k") < 1), "empty_partition")
        .when(~F.col("finite_refit"), "fixed_partition_refit_nonfinite")
        .when(~resolved, "fixed_partition_refit_numerically_unresolved")
        .when(F.isnan("score") | (F.abs("score") == float("inf")) | F.col("score").isNull(), "fixed_partition_score_nonfinite")
        .otherwise("none")
    )


def has_exact_certificate() -> Column:
    """Whether a raw candidate's certificate admits it: every condition of the admission contract, over its columns."""
    def finite(c: str) -> Column:
        return ~F.isnan(c) & (F.abs(c) < float("inf"))

    conditions = [
        F.col("is_raw"), ineligibility() == "none", F.col("objective_certified"), F.col("lam") > 0, F.col("partition_certified"), F.col("cert_schema") == EXACT["schema"], F.col("cert_method") == EXACT["method"],
        F.col("cert_dtype") == EXACT["dtype"], F.col("admissible"), *[F.trim(h) != "" for h in ("objective_hash", "graph_hash", "problem_hash")], F.col("cert_scope") == EXACT["scope"],
        F.col("gradient_scope").isin(*GRADIENT_SCOPES), F.col("certified"), F.col("cert_status").isin(*STATUSES), finite("kkt"), finite("kkt_tolerance"), F.col("kkt_tolerance") > 0, F.col("kkt") <= F.col("kkt_tolerance"),
    ]
    out = F.lit(True)
    for c in conditions:
        out = out & F.coalesce(c, F.lit(False))
    return out


def selection_eligible(strict: bool = False) -> Column:
    """Raw candidates by their certificate; direct ones if nothing speaks against them and exact fusion isn't demanded."""
    return F.when(F.col("is_raw"), has_exact_certificate()).otherwise((ineligibility() == "none") & F.lit(not strict))


def raw_reference(rows: DataFrame) -> DataFrame:
    """The raw candidate of each tumor that others are reported against: of those with an exact certificate the best score."""
    return scores.best_per(rows.filter(has_exact_certificate()), ["tumor_id"], ["score", "uncertainty", "lam", "objective", "candidate_id"])


def best_start(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """The start whose basin counts, for each of ``keys``: of certified ones the lowest objective, then residual, then source;
    without any, the lowest objective. What isn't finite comes last."""
    def last(c: str) -> Column:
        return F.when(F.isnan(c) | F.col(c).isNull(), float("inf")).otherwise(F.col(c))

    rows = attempts.withColumns({"_not": (~F.col("certified")).cast("int"), "_o": last("objective"), "_r": last("kkt")})
    return scores.best_per(rows, keys, ["_not", "_o", "_r", "source"]).drop("_not", "_o", "_r")


def final_parents(rows: DataFrame, n: int = 1) -> DataFrame:
    """The n best raw candidates of each tumor, from whose profiles further partitions are proposed."""
    return scores.best_per(rows.filter("is_raw"), ["tumor_id"], ["score", "lam", "candidate_id"], n)


def failure_summary(rows: DataFrame) -> DataFrame:
    """(tumor_id, n_raw, n_certified, n_partition_certified, n_direct, n_direct_eligible, least_kkt, its tolerance): what is reported
    where no raw candidate has an exact certificate."""
    fine = F.when(~F.isnan("kkt"), F.struct("kkt", "kkt_tolerance"))
    raw = F.col("is_raw")
    return rows.groupBy("tumor_id").agg(
        F.count_if(raw).alias("n_raw"), F.count_if(raw & F.col("objective_certified")).alias("n_certified"), F.count_if(raw & F.col("partition_certified")).alias("n_partition_certified"), F.count_if(~raw).alias("n_direct"),
        F.count_if(~raw & (ineligibility() == "none")).alias("n_direct_eligible"), F.min(F.when(raw, fine))["kkt"].alias("least_kkt"), F.min(F.when(raw, fine))["kkt_tolerance"].alias("least_kkt_tolerance"),
    )


def direct_source(stage: Column, refined: Column, died: Column) -> Column:
    """What a direct partition is called: its stage, whether it was refined, and whether a cluster died on the way."""
    return F.concat(F.when(stage == "pilot", "pilot").otherwise("final_phi"), F.when(refined, "_hessian_ward_cem").otherwise("_hessian_ward"), F.when(refined & died, "_component_death").otherwise(""))


def joined_reasons(*reasons: Column) -> Column:
    """Distinct reasons that aren't blank, in order, with semicolons between them."""
    kept = F.filter(F.transform(F.array(*reasons), lambda r: F.trim(F.coalesce(r, F.lit("")))), lambda r: r != "")
    return F.array_join(F.array_distinct(kept), ";")
