"""Partitions from profiles: diameters, distances between blocks, components at a tolerance, complete-link blocks."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import graph


def _clustered(profile: DataFrame, labels: DataFrame, n_regions: int | None) -> tuple[DataFrame, list[str]]:
    nodes, names = graph.columns_of(profile, graph.regions_of(profile) if n_regions is None else n_regions)
    return nodes.join(labels.select("tumor_id", "mutation_id", "cluster"), ["tumor_id", "mutation_id"]), names


def diameters(profile: DataFrame, labels: DataFrame, n_regions: int | None = None) -> DataFrame:
    """(tumor_id, cluster, diameter): the largest distance within each cluster, 0 for single mutations. Only pairs of one cluster
    are made, of different profiles that may be its ends."""
    nodes, names = _clustered(profile, labels, n_regions)
    inner = graph.farthest(nodes, names, ("tumor_id", "cluster"))
    return labels.select("tumor_id", "cluster").distinct().join(inner, ["tumor_id", "cluster"], "left").select("tumor_id", "cluster", F.coalesce("d", F.lit(0.0)).alias("diameter"))


def center_gaps(centers: DataFrame, keys: tuple[str, ...] = ("tumor_id",)) -> DataFrame:
    """(keys, nearest): the least distance between two clusters' centers, (keys, cluster, sample_id, beta); no row for a single one.
    Pairs of clusters meet, not pairs of their members."""
    k = list(keys)
    x = centers.groupBy(*k, "cluster").agg(F.map_from_entries(F.collect_list(F.struct("sample_id", "beta"))).alias("x"))
    both = x.join(x.select(*k, F.col("cluster").alias("c2"), F.col("x").alias("x2")), k).filter("cluster < c2")
    d = F.aggregate(F.map_entries("x"), F.lit(0.0), lambda a, e: a + (e["value"] - F.try_element_at("x2", e["key"])) * (e["value"] - F.try_element_at("x2", e["key"])))
    return both.groupBy(*k).agg(F.min(F.sqrt(d)).alias("nearest"))


def cross_distances(profile: DataFrame, labels: DataFrame, n_regions: int | None = None) -> DataFrame:
    """(tumor_id, a, b, farthest, nearest) for every two clusters a < b of a tumor. Equal profiles of a cluster meet as one."""
    nodes, names = _clustered(profile, labels, n_regions)
    cross = graph.pairs(graph.classes(nodes, "cluster", *names), "cluster", *names).filter("cluster_u <> cluster_v").withColumn("d", F.sqrt(graph._squares(names)))
    return cross.groupBy("tumor_id", F.least("cluster_u", "cluster_v").alias("a"), F.greatest("cluster_u", "cluster_v").alias("b")).agg(F.max("d").alias("farthest"), F.min("d").alias("nearest"))


def mergeable(profile: DataFrame, labels: DataFrame, tolerance: float) -> DataFrame:
    """(tumor_id, mergeable): whether two clusters of the tumor could be one with a diameter within the tolerance."""
    found = cross_distances(profile, labels).groupBy("tumor_id").agg(F.bool_or(F.col("farthest") <= tolerance).alias("mergeable"))
    return labels.select("tumor_id").distinct().join(found, "tumor_id", "left").select("tumor_id", F.coalesce("mergeable", F.lit(False)).alias("mergeable"))


def ensure_checkpoints(spark: SparkSession) -> None:
    """Sets the session's checkpoint folder from ``spark.checkpoint.dir``; in local mode a new folder will do."""
    if spark.sparkContext.getCheckpointDir():
        return
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[[\d*, ]+\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="checkpoint-")
    spark.sparkContext.setCheckpointDir(at)


def written(rows: DataFrame) -> DataFrame:
    """``rows`` as a table in the session's checkpoint folder. Unlike a checkpoint it has sizes of its own: a checkpoint keeps its plan's
    estimate, a product over joins, which in rounds becomes a number of so many digits that planning doesn't end."""
    at = f"{rows.sparkSession.sparkContext.getCheckpointDir()}/rows-{uuid.uuid4().hex}"
    rows.write.parquet(at)
    return rows.sparkSession.read.schema(rows.schema).parquet(at)


def components(profile: DataFrame, tolerance: float, max_rounds: int = 60, n_regions: int | None = None) -> DataFrame:
    """(tumor_id, mutation_id, component): the least mutation id that a chain of pairs within the tolerance reaches.

    Mutations with equal profiles, observed in the same regions, are near to the same others: they are one node, named by the least of
    them, and linked by any other near node if not to each other. Each round takes the least label among the neighbours, then the
    label of that label; each round is written to the session's checkpoint folder.
    """
    ensure_checkpoints(profile.sparkSession)
    nodes, names = graph.masked_columns(profile, graph.regions_of(profile) if n_regions is None else n_regions)
    nodes = nodes.checkpoint()  # read for the classes and for their members
    found = graph.classes(nodes, *names).checkpoint()
    near = graph.class_pairs(found, *names).filter(graph.shared_distance(names)[1] <= tolerance).select("tumor_id", "u", "v").checkpoint()
    linked = near.select("tumor_id", F.explode(F.array("u", "v")).alias("u")).distinct().withColumn("linked", F.lit(True))
    near = near.filter("u <> v")
    near = near.union(near.select("tumor_id", F.col("v").alias("u"), F.col("u").alias("v"))).checkpoint()
    now = found.select("tumor_id", F.col("mutation_id").alias("u"), F.col("mutation_id").alias("c"))
    for _ in range(max_rounds):
        least = near.join(now.select("tumor_id", F.col("u").alias("v"), F.col("c").alias("cv")), ["tumor_id", "v"]).groupBy("tumor_id", "u").agg(F.min("cv").alias("cv"))
        step = now.join(least, ["tumor_id", "u"], "left").select("tumor_id", "u", "c", F.least("c", F.coalesce("cv", "c")).alias("m"))
        jump = now.select("tumor_id", F.col("u").alias("m"), F.col("c").alias("mc"))
        step = step.join(jump, ["tumor_id", "m"]).select("tumor_id", "u", F.col("c").alias("old"), F.least("m", "mc").alias("c"))
        step = written(step)
        now = step.select("tumor_id", "u", "c")
        if not step.filter("old <> c").limit(1).count():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    known = found.join(now.join(linked, ["tumor_id", "u"], "left").withColumnRenamed("u", "mutation_id"), ["tumor_id", "mutation_id"])
    return graph.member_rows(nodes, known, names, "c", "linked").select("tumor_id", "mutation_id", F.when(F.col("linked"), F.col("c")).otherwise(F.col("mutation_id")).alias("component"))


def complete_link_labels(phi: np.ndarray, tolerance: float) -> np.ndarray:
    """Blocks of diameter within the tolerance: rows join, in lexicographic order, the oldest block that can take them.

    Blocks are ruled out, or in, by the nearest and the furthest point of their bounding boxes, all at once; distances to
    members are taken for those in between only. Blocks are numbered by their first rows.
    """
    n = len(phi)
    order, owner, n_blocks = np.lexsort(phi.T[::-1]), np.empty(n, dtype=np.int64), 0  # a stable sort: equal rows in their own order
    low, high = np.empty_like(phi), np.empty_like(phi)
    for done, i in enumerate(order):
        x, lo, hi = phi[i], low[:n_blocks], high[:n_blocks]
        near = np.linalg.norm(np.maximum(np.maximum(lo - x, x - hi), 0.0), axis=1)
        far = np.linalg.norm(np.maximum(np.abs(x - lo), np.abs(x - hi)), axis=1)
        earlier = order[:done]
        block = next((k for k in np.flatnonzero(near <= tolerance) if far[k] <= tolerance or np.linalg.norm(phi[earlier[owner[earlier] == k]] - x, axis=1).max() <= tolerance), n_blocks)
        if block == n_blocks:
            low[block], high[block] = x, x
            n_blocks += 1
        else:
            low[block], high[block] = np.minimum(low[block], x), np.maximum(high[block], x)
        owner[i] = block
    _, first, back = np.unique(owner, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[back.reshape(-1)].astype(np.int64)


def complete_link(profile: DataFrame, tolerance: float) -> DataFrame:
    """(tumor_id, mutation_id, cluster): complete-link blocks of each tumor, a group function since the order decides."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="mutation_id", columns="sample_id", values="phi").sort_index()
        return pd.DataFrame({"tumor_id": pdf.tumor_id.iloc[0], "mutation_id": wide.index, "cluster": complete_link_labels(wide.to_numpy(), tolerance)})

    return profile.select("tumor_id", "mutation_id", "sample_id", "phi").groupBy("tumor_id").applyInPandas(run, "tumor_id string, mutation_id long, cluster int")
