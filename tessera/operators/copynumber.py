"""Local copy number: merged states, dominant state, mean copy number, scaling, and the units that likelihoods read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.likelihood import EPS

SEGMENT = ["tumor_id", "sample_id", "segment_id"]
UNIT = ["tumor_id", "mutation_id", "sample_id"]


def canonical_purity(long: DataFrame) -> DataFrame:
    """(tumor_id, sample_id, purity, purity_spread): the least purity named for a region, and how far the names differ."""
    return long.groupBy("tumor_id", "sample_id").agg(F.min("purity").alias("purity"), (F.max("purity") - F.min("purity")).alias("purity_spread"))


def merged_states(long: DataFrame) -> DataFrame:
    """(segment, allele_a_cn, allele_b_cn, fraction, fraction_sum): states with equal allele pairs are one, their fractions
    added; a state's fraction is the least that its rows name."""
    states = long.groupBy(*SEGMENT, "cn_state_id", "allele_a_cn", "allele_b_cn").agg(F.min("cn_state_fraction").alias("f"))
    merged = states.groupBy(*SEGMENT, "allele_a_cn", "allele_b_cn").agg(F.sum("f").alias("fraction"))
    return merged.withColumn("fraction_sum", F.sum("fraction").over(Window.partitionBy(*SEGMENT)))


def segments(long: DataFrame) -> DataFrame:
    """One row for each tumor, region and segment: states as an array sorted by allele pair, mean_cn, has_cna, the dominant
    state (largest by fraction, copies, a, b) as major and minor, and why its paths are unsupported, if they are."""
    merged = merged_states(long)
    a, b, f = F.col("allele_a_cn"), F.col("allele_b_cn"), F.col("fraction")
    out = merged.groupBy(*SEGMENT).agg(
        F.array_sort(F.collect_list(F.struct(a.alias("a"), b.alias("b"), f.alias("f")))).alias("states"),
        F.sum(f * (a + b)).alias("mean_cn"), F.bool_or((a != 1) | (b != 1)).alias("has_cna"), F.max(F.greatest(a, b)).alias("most_copies"),
        F.max_by(F.struct(F.greatest(a, b).alias("major"), F.least(a, b).alias("minor")), F.struct(f, a + b, a, b)).alias("dominant"),
    )
    reason = F.when(F.size("states") > 2, "MORE_THAN_TWO_LOCAL_CN_STATES").when(F.col("most_copies") < 1, "NO_POSITIVE_MUTANT_COPY_PATH")
    return out.select(*SEGMENT, "states", "mean_cn", "has_cna", F.col("dominant.major").alias("major_cn"), F.col("dominant.minor").alias("minor_cn"), reason.alias("unsupported_reason"))


def scaling(purity="purity", normal_cn="normal_cn", mean_cn="mean_cn"):
    """Read probability of one mutant copy in all tumor cells."""
    p = F.col(purity)
    return p / ((1.0 - p) * F.col(normal_cn) + p * F.col(mean_cn))


def low_multiplicity(major="major_cn", minor="minor_cn"):
    return F.when((F.col(minor) >= 1) & (F.col(minor) != F.col(major)), F.col(minor)).otherwise(F.lit(1))


def multiplicity_estimated(major="major_cn", minor="minor_cn", has_cna="has_cna"):
    low = low_multiplicity(major, minor)
    return F.col(has_cna) & (low < F.col(major))


def units(long: DataFrame, eps: float = EPS) -> DataFrame:
    """One row for each mutation and region with its segment's description, scaling, route and bound of phi. Unsupported
    units lose their counts. A tumor with any two-state segment takes the path route for all its units."""
    obs = long.groupBy(*UNIT, "segment_id").agg(F.first("alt_count").alias("alt_count"), F.first("ref_count").alias("ref_count"), F.first("count_observed").alias("count_observed"), F.min("purity").alias("purity"), F.min("normal_cn").alias("normal_cn"))
    seg = segments(long)
    route = seg.groupBy("tumor_id").agg((F.max(F.size("states")) > 1).alias("path_route"))
    out = obs.join(seg, SEGMENT).join(route, "tumor_id").withColumn("scaling", scaling())
    observed = F.col("count_observed") & F.col("unsupported_reason").isNull()
    alt, nonalt = (F.when(observed, F.col(c)).otherwise(0).cast("double") for c in ("alt_count", "ref_count"))
    c, major, minor = F.col("scaling"), F.col("major_cn"), F.col("minor_cn")
    bound = F.least(F.lit(1.0), (1.0 - eps) / F.greatest(c * major, c * minor, F.lit(eps)))
    upper = F.when(F.col("path_route"), F.lit(1.0)).otherwise(F.least(F.greatest(bound, F.lit(eps)), F.lit(1.0)))
    return out.withColumns({"observed": observed, "alt": alt, "nonalt": nonalt, "phi_upper": upper, "multiplicity_low": low_multiplicity(), "multiplicity_estimated": multiplicity_estimated()})


def phi_init(eps: float = EPS):
    """Start value of phi from smoothed counts: that of the major or the minor copy number, whichever explains them better."""
    n, up = F.col("alt") + F.col("nonalt"), F.col("phi_upper")
    vaf = (F.col("alt") + 0.5) / (n + 1.0)

    def phi(m):
        return F.least(F.greatest(vaf / F.greatest(F.col("scaling") * F.col(m), F.lit(eps)), F.lit(0.0)), up)

    def log_likelihood(m):
        p = F.least(F.greatest(F.col("scaling") * F.col(m) * phi(m), F.lit(eps)), F.lit(1.0 - eps))
        return F.col("alt") * F.ln(p) + F.col("nonalt") * F.ln(1.0 - p)

    best = F.when(log_likelihood("major_cn") >= log_likelihood("minor_cn"), phi("major_cn")).otherwise(phi("minor_cn"))
    return F.least(F.greatest(best, F.lit(eps)), up)
