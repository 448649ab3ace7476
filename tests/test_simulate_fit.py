import numpy as np
import pytest

from tessera.operators import copynumber, kernels, validate
from tessera.plans import config, fit, simulate


def test_simulated_tables_are_valid_and_repeatable(spark):
    settings = simulate.SimulationConfig(mutations=40, segments=6, seed=3)
    tables = simulate.simulate(spark, 3, settings)
    long = tables["long"].toPandas()
    assert validate.problems(tables["long"]).count() == 0
    assert long.equals(simulate.simulate(spark, 3, settings)["long"].toPandas())
    truth = tables["truth_clone"].toPandas()
    assert np.allclose(truth.groupby(["tumor_id", "sample_id"]).exclusive_fraction.sum(), 1)
    assert np.allclose(truth[truth.parent_id < 0].ccf, 1)
    for _, own in truth.groupby(["tumor_id", "sample_id"]):
        for _, c in own.iterrows():
            assert np.isclose(c.ccf, c.exclusive_fraction + own[own.parent_id == c.clone_id].ccf.sum())
    mean = copynumber.segments(tables["long"]).toPandas().merge(long[["tumor_id", "sample_id", "segment_id", "mutation_id"]].drop_duplicates()).merge(tables["truth_mutation"].toPandas())
    assert np.allclose(mean.mean_cn, mean.mean_total_cn)


def test_truth_tables_follow_from_trees_gains_and_mutations(spark):
    settings = simulate.SimulationConfig(mutations=60, clones=4, segments=6, gain_rate=0.9, seed=9)
    tables = simulate.simulate(spark, 2, settings)
    truth = simulate.truth_tables(tables, settings)
    key = ["tumor_id", "mutation_id", "sample_id"]
    both = truth["mutation_samples"].toPandas().merge(tables["truth_mutation"].toPandas(), on=key, suffixes=("", "_kernel"))
    assert len(both) == 2 * 60 * 2
    for c in ("ccf", "mutant_copy_mass", "mean_total_cn", "expected_vaf"):
        assert np.allclose(both[c], both[f"{c}_kernel"], atol=1e-9)
    assert truth["violations"].count() == 0
    assert np.allclose(truth["cn_clone_fractions"].toPandas().groupby(["tumor_id", "sample_id"]).fraction.sum(), 1)
    states = truth["unphased_states"].toPandas()
    long = tables["long"].toPandas()[["tumor_id", "sample_id", "segment_id", "allele_a_cn", "allele_b_cn", "cn_state_fraction"]].drop_duplicates()
    seen = states.merge(long, on=["tumor_id", "sample_id", "segment_id", "allele_a_cn", "allele_b_cn"])
    assert len(seen) == len(long) and np.allclose(seen.fraction, seen.cn_state_fraction)
    row = {r.tumor_id: r for r in truth["complexity"].collect()}
    assert len(row) == 2 and all(r.maximum_allele_cn == 2 and 0 < r.altered_segment_fraction <= 1 for r in row.values())
    pairs, summary = truth["gain_timing"].toPandas(), {r.tumor_id: r for r in truth["gain_timing_summary"].collect()}
    assert all(summary[n].n_pairs == len(own) and np.isclose(summary[n].before_share, own.precedes.mean()) for n, own in pairs.groupby("tumor_id"))


def test_score_names_and_flags():
    from tessera.__main__ import parser

    args = parser().parse_args(["fit", "in", "out", "--selection-score", "Fixed_Partition_BIC", "--explore", "3", "--skip-outputs"])
    assert args.selection_score == "fixed-partition-bic" and args.explore == 3 and args.skip_outputs
    assert config.resolve("fast", selection_score="fixed_partition_bic").code_weight == 0 and config.resolve("fast").code_weight == 0.7
    for bad in ("clonal-anchor", "icl"):
        with pytest.raises(SystemExit):
            parser().parse_args(["fit", "in", "out", "--selection-score", bad])
        with pytest.raises(ValueError):
            config.score_name(bad)
    assert config.prior_mode(3) == "endpoint_excess_dosage_penalty_biological_alias_mass_v1:alpha=3"


def test_easy_tumor_is_recovered(spark):
    long = simulate.simulate(spark, 1, simulate.SimulationConfig(mutations=30, clones=2, segments=5, depth=400, purity=0.9, gain_rate=0.0, seed=5))
    out = fit.fit_cohort(long["long"], config.resolve("fast", explore=2, refine=0))
    got = out["mutation_clusters"].toPandas().merge(long["truth_mutation"].filter("sample_id = 'region1'").toPandas())
    assert np.abs(got.phi_region1 - got.ccf).mean() < 0.08
    assert out["cluster_centers"].count() == out["summary"].first().n_clusters
    assert out["mutation_region_multiplicity"].count() == 60


def test_settings_are_checked():
    assert config.resolve(" Fast ").refine == 0
    for bad in ({"major_prior": 1.0}, {"partition_tolerance": 0}, {"explore": 0}, {"unsupported": "skip"}, {"code_weight": float("inf")}):
        with pytest.raises(ValueError):
            config.resolve(**bad)
    with pytest.raises(ValueError):
        config.resolve("slow")
    with pytest.raises(ValueError):
        simulate.SimulationConfig(mutations=1)
    assert kernels.Controller(1.0).propose() == 1.0
