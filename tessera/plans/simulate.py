"""Simulated tumors with their truth: a clone tree with fractions in each region, copy gains on branches, mutations, reads.

Each tumor is one group with its own random stream, so a cohort is simulated in parallel and a tumor doesn't depend on others.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import clones, partitions
from tessera.operators.validate import COLUMNS


@dataclass(frozen=True)
class SimulationConfig:
    mutations: int = 300
    regions: int = 2
    clones: int = 3
    segments: int = 10
    depth: float = 100.0
    purity: float = 0.6
    gain_rate: float = 0.5
    seed: int = 0

    def __post_init__(self):
        if self.mutations < self.clones or min(self.clones, self.regions, self.segments) < 1 or not 0 < self.purity <= 1 or self.depth <= 0 or not 0 <= self.gain_rate <= 1:
            raise ValueError("settings out of range")


def _tree(rng: np.random.Generator, n: int, regions: int) -> tuple[np.ndarray, np.ndarray]:
    """Parents (-1 for the root) and each clone's own share of cells by region; a subtree's share is its cell fraction."""
    parent = np.array([-1] + [int(rng.integers(0, i)) for i in range(1, n)])
    return parent, rng.dirichlet(np.full(n, 2.0), regions).T


def _lineage(parent: np.ndarray) -> np.ndarray:
    """below[i, j]: clone j is i or descends from it. Parents come before their children."""
    below = np.eye(len(parent), dtype=bool)
    for j in range(1, len(parent)):
        below[:, j] |= below[:, parent[j]]
    return below


def simulate_one(name: str, config: SimulationConfig) -> dict[str, pd.DataFrame]:
    """Tables of one tumor: long, truth_mutation, truth_clone, truth_gain. At most one gain a segment, so a segment has at most
    two local states; a gain doubles one allele, and the copies of mutations that sit on it and came before."""
    rng = np.random.default_rng([config.seed, *name.encode()])
    parent, own = _tree(rng, config.clones, config.regions)
    below = _lineage(parent)
    ccf = below @ own
    regions = [f"region{r + 1}" for r in range(config.regions)]
    gained = np.where(rng.random(config.segments) < config.gain_rate, rng.integers(0, config.clones, config.segments), -1)
    when, allele = rng.random(config.segments), rng.integers(0, 2, config.segments)
    clone = np.concatenate((np.arange(config.clones), rng.integers(0, config.clones, config.mutations - config.clones)))
    segment, at, side = rng.integers(0, config.segments, config.mutations), rng.random(config.mutations), rng.integers(0, 2, config.mutations)
    g = gained[segment]
    has_gain = (g[:, None] >= 0) & below[np.maximum(g, 0)]  # mutation by clone: the clone has the segment's gain
    early = (g >= 0) & (side == allele[segment]) & (((clone == g) & (at < when[segment])) | ((clone != g) & below[clone, np.maximum(g, 0)]))
    dosage = below[clone] * (1 + (early[:, None] & has_gain))
    long, rows = [], []
    for r, region in enumerate(regions):
        share = own[:, r]
        mass, total = dosage @ share, 2 + has_gain @ share
        p = config.purity * mass / (config.purity * total + (1 - config.purity) * 2)
        depth = rng.poisson(config.depth, config.mutations)
        alt = rng.binomial(depth, p)
        rows.append(pd.DataFrame({"sample_id": region, "mutation_id": [f"m{i:05d}" for i in range(config.mutations)], "clone_id": clone, "ccf": ccf[clone, r], "mutant_copy_mass": mass, "mean_total_cn": total, "expected_vaf": p}))
        for i in range(config.mutations):
            f = float(has_gain[i] @ share)
            states = [(1, 1, 1 - f), (2, 1, f)] if 1e-9 < f < 1 - 1e-9 else [(2, 1, 1.0)] if f >= 0.5 else [(1, 1, 1.0)]
            for k, (a, b, x) in enumerate(states):
                long.append((f"m{i:05d}", region, int(alt[i]), int(depth[i] - alt[i]), True, config.purity, 2.0, f"seg{segment[i]}", f"{a}{b}", x, a, b))
    return {
        "long": pd.DataFrame(long, columns=COLUMNS).assign(tumor_id=name)[["tumor_id", *COLUMNS]],
        "truth_mutation": pd.concat(rows).assign(tumor_id=name)[["tumor_id", "sample_id", "mutation_id", "clone_id", "ccf", "mutant_copy_mass", "mean_total_cn", "expected_vaf"]],
        "truth_clone": pd.DataFrame([(name, k, int(parent[k]), s, own[k, r], ccf[k, r]) for k in range(config.clones) for r, s in enumerate(regions)], columns=["tumor_id", "clone_id", "parent_id", "sample_id", "exclusive_fraction", "ccf"]),
        "truth_snv": pd.DataFrame({"tumor_id": name, "mutation_id": [f"m{i:05d}" for i in range(config.mutations)], "clone_id": clone, "segment_id": [f"seg{k}" for k in segment], "allele": np.array(list("AB"))[side], "branch_time": at}),
        "truth_gain": pd.DataFrame([(name, f"seg{s}", int(gained[s]), "AB"[allele[s]], float(when[s])) for s in np.flatnonzero(gained >= 0)], columns=["tumor_id", "segment_id", "clone_id", "allele", "branch_time"]),
    }


SCHEMAS = {
    "long": "tumor_id string, mutation_id string, sample_id string, alt_count long, ref_count long, count_observed boolean, purity double, normal_cn double, segment_id string, cn_state_id string, cn_state_fraction double, allele_a_cn int, allele_b_cn int",
    "truth_mutation": "tumor_id string, sample_id string, mutation_id string, clone_id long, ccf double, mutant_copy_mass double, mean_total_cn double, expected_vaf double",
    "truth_clone": "tumor_id string, clone_id long, parent_id long, sample_id string, exclusive_fraction double, ccf double",
    "truth_snv": "tumor_id string, mutation_id string, clone_id long, segment_id string, allele string, branch_time double",
    "truth_gain": "tumor_id string, segment_id string, clone_id long, allele string, branch_time double",
}


def simulate(spark: SparkSession, tumors: int, config: SimulationConfig = SimulationConfig()) -> dict[str, DataFrame]:
    """The tables of a simulated cohort; equal settings give equal tables. Every tumor is simulated once: its rows of all tables
    are written together, as a checkpoint, and read by kind."""
    partitions.ensure_checkpoints(spark)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        made = simulate_one(rows.tumor_id.iloc[0], config)
        return pd.DataFrame([(kind, json.dumps(row)) for kind, table in made.items() for row in json.loads(table.to_json(orient="records", double_precision=15))], columns=["kind", "row"])

    names = spark.range(tumors).select(F.format_string("tumor%06d", "id").alias("tumor_id"))
    rows = names.groupBy("tumor_id").applyInPandas(run, "kind string, row string").checkpoint()
    return {kind: rows.filter(F.col("kind") == kind).select(F.from_json("row", schema).alias("r")).select("r.*") for kind, schema in SCHEMAS.items()}


def truth_tables(tables: dict[str, DataFrame], config: SimulationConfig) -> dict[str, DataFrame]:
    """What follows from a cohort's trees, gains and mutations, as relations: lineages, copies, profiles and their cells, local
    states, copies of each mutation, what its reads are expected to be, timing against gains, and a tumor's complexity."""
    clone = tables["truth_clone"]
    tree, cells = clone.select("tumor_id", "clone_id", "parent_id").distinct(), clone.select("tumor_id", "clone_id", "sample_id", "ccf")
    line, own = clones.descendants(tree), clones.exclusive_fractions(tree, cells)
    segments = tree.sparkSession.range(config.segments).select(F.concat(F.lit("seg"), F.col("id").cast("string")).alias("segment_id"))
    gains = tables["truth_gain"].join(line, ["tumor_id", "clone_id"]).select("tumor_id", F.col("below").alias("clone_id"), "segment_id", F.col("allele").alias("gained"), F.col("clone_id").alias("gain_clone"), F.col("branch_time").alias("gain_time"))
    copies = tree.select("tumor_id", "clone_id").join(F.broadcast(segments)).join(gains, ["tumor_id", "clone_id", "segment_id"], "left")
    phased = copies.select("tumor_id", "clone_id", "segment_id", *[F.when(F.col("gained") == x, 2).otherwise(1).alias(f"allele_{x.lower()}_cn") for x in "AB"])
    snv = tables["truth_snv"]
    lies = line.select("tumor_id", F.col("clone_id").alias("origin"), F.col("below").alias("clone_id"))
    at = snv.withColumnRenamed("clone_id", "origin").join(tree.select("tumor_id", "clone_id"), "tumor_id").join(lies.withColumn("has", F.lit(True)), ["tumor_id", "origin", "clone_id"], "left")
    at = at.join(gains, ["tumor_id", "clone_id", "segment_id"], "left")
    under = line.select("tumor_id", F.col("clone_id").alias("origin"), F.col("below").alias("gain_clone"), F.lit(True).alias("gain_under"))
    at = at.join(under, ["tumor_id", "origin", "gain_clone"], "left")
    early = F.when(F.col("origin") == F.col("gain_clone"), F.col("branch_time") < F.col("gain_time")).otherwise(F.coalesce("gain_under", F.lit(False)))
    dose = F.when(F.col("has").isNull(), 0).when(F.col("gained").isNotNull() & (F.col("gained") == F.col("allele")) & early, 2).otherwise(1)
    dosage = at.select("tumor_id", "mutation_id", "segment_id", "clone_id", dose.alias("dosage"))
    ids = clones.profile_ids(phased)
    truth = clones.mutation_truth(dosage, own, phased, config.purity)
    events = tables["truth_gain"].withColumn("event_id", F.col("segment_id"))
    pairs = clones.timing(snv.select("tumor_id", "mutation_id", "clone_id", "segment_id", "branch_time"), events, line)
    return {
        "lineage": line, "exclusive_fractions": own, "clone_copies": phased, "cn_clone_ids": ids, "cn_clone_fractions": clones.profile_fractions(own, ids), "local_states": clones.local_states(phased, own),
        "unphased_states": clones.local_states(phased, own, phased=False, least=1e-9).drop("clones"), "mutation_dosage": dosage, "mutation_samples": truth, "gain_timing": pairs, "gain_timing_summary": clones.timing_summary(pairs, snv),
        "complexity": clones.complexity(phased, ids, snv, events, truth, dosage), "violations": clones.violations(tree, cells),
    }
