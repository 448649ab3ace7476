"""Fixed-partition refits on a grid of centers, and costs of mutations at given centers.

A unit's losses at many centers are one matrix (its paths by the centers): they are computed a batch of units at a time in Arrow,
next to the scan and without a shuffle. What is summed, joined and ranked afterwards are columns again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import likelihood as L

GRID = 64


def grid_column(points: int = GRID, lower: float = L.EPS, upper: float = 1.0):
    """Array of equally spaced centers."""
    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.lit(lower) + i.cast("double") * F.lit((upper - lower) / (points - 1)))


#: Path rows times centers that are held at once, about.
CELLS = 1 << 19


def _losses(batch: pa.RecordBatch, centers: np.ndarray | None) -> np.ndarray:
    """(units, centers): losses of a batch with alt, nonalt, scaling, paths at common ``centers``, or at those of its own column."""
    paths = batch.column("paths")
    n = paths.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    unit = np.repeat(np.arange(len(n)), n)
    flat = paths.flatten()
    switch, first, second, prior = (flat.field(x).to_numpy(zero_copy_only=False)[:, None] for x in ("switch", "first", "second", "log_prior"))
    alt, nonalt, scaling = (batch.column(x).to_numpy(zero_copy_only=False)[unit][:, None] for x in ("alt", "nonalt", "scaling"))
    if centers is None:
        centers = batch.column("betas").flatten().to_numpy(zero_copy_only=False).reshape(len(n), -1)[unit]
    q = np.clip(scaling * (first * np.minimum(centers, switch) + second * np.maximum(centers - switch, 0.0)), L.EPS, 1.0 - L.EPS)
    terms = alt * np.log(q) + nonalt * np.log(1.0 - q) + prior
    starts = np.concatenate((np.zeros(1, dtype=np.int64), np.cumsum(n)[:-1]))
    top = np.maximum.reduceat(terms, starts, axis=0)
    return -(top + np.log(np.add.reduceat(np.exp(terms - top[unit]), starts, axis=0)))


def _with_losses(rows: DataFrame, keep: list[str], points: int | None) -> DataFrame:
    """``keep`` and losses, an array over the grid or over the row's own betas. Every unit has a path; neighbours with as many
    betas are computed together."""
    grid = None if points is None else L.EPS + np.arange(points, dtype=float) * ((1.0 - L.EPS) / (points - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            wide = np.full(b.num_rows, points) if grid is not None else b.column("betas").value_lengths().to_numpy(zero_copy_only=False)
            size = np.cumsum(b.column("paths").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) * wide)
            cut = (np.flatnonzero((np.diff(size // CELLS) > 0) | (np.diff(wide) != 0)) + 1).tolist()
            for start, end in zip([0, *cut], [*cut, b.num_rows], strict=True):
                part = b.slice(start, end - start)
                got = _losses(part, grid)
                out = pa.ListArray.from_arrays(pa.array(np.arange(len(got) + 1, dtype=np.int32) * np.int32(got.shape[1])), pa.array(got.ravel()))
                yield pa.record_batch([*(part.column(c) for c in keep), out], names=[*keep, "losses"])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep) + ", losses array<double>"
    paths = F.transform("paths", lambda p: F.struct(*[p[x].cast("double").alias(x) for x in ("switch", "first", "second", "log_prior")])).alias("paths")
    counts = [F.col(c).cast("double").alias(c) for c in ("alt", "nonalt", "scaling")]
    return rows.select(*keep, *counts, paths, *(["betas"] if points is None else [])).mapInArrow(run, schema)


def unit_losses(units: DataFrame, points: int = GRID) -> DataFrame:
    """(tumor_id, mutation_id, sample_id, losses): the losses of observed units at every center of the grid."""
    return _with_losses(units.filter("observed"), ["tumor_id", "mutation_id", "sample_id"], points)


def loss_grid(units: DataFrame, labels: DataFrame | None = None, points: int = GRID) -> DataFrame:
    """(tumor_id, cluster, sample_id, beta, loss): the loss of a cluster's observed units at each center of the grid. Without
    labels a tumor is one cluster.

    The grid stays an array in each unit's row and is summed center by center as columns, so rows are neither joined nor
    shuffled once for each center.
    """
    rows = unit_losses(units, points)
    rows = rows.withColumn("cluster", F.lit(0)) if labels is None else rows.join(labels.select("tumor_id", "mutation_id", "cluster"), ["tumor_id", "mutation_id"])
    sums = rows.groupBy("tumor_id", "cluster", "sample_id").agg(*[F.sum(F.get("losses", F.lit(i))).alias(f"s{i}") for i in range(points)])
    at = F.arrays_zip(grid_column(points).alias("beta"), F.array(*[f"s{i}" for i in range(points)]).alias("loss"))
    return sums.select("tumor_id", "cluster", "sample_id", F.explode(at).alias("g")).select("tumor_id", "cluster", "sample_id", F.col("g.beta").alias("beta"), F.col("g.loss").alias("loss"))


def best_centers(grid: DataFrame, decimals: int = 9) -> DataFrame:
    """(tumor_id, cluster, sample_id, beta, loss): the least loss, then the least center."""
    best = grid.groupBy("tumor_id", "cluster", "sample_id").agg(F.min(F.struct(F.round("loss", decimals).alias("r"), "beta", "loss")).alias("b"))
    return best.select("tumor_id", "cluster", "sample_id", F.col("b.beta").alias("beta"), F.col("b.loss").alias("loss"))


def refined_centers(units: DataFrame, centers: DataFrame, spacing: float, labels: DataFrame | None = None, steps: int = 3) -> DataFrame:
    """``centers`` after rounds of five points between the neighbours of the best one; each round shrinks the spacing fourfold
    at least. All clusters of the cohort go through a round together."""
    for _ in range(steps):
        spacing = spacing / 2
        near = F.transform(F.array(*[F.lit(k * spacing) for k in (-2, -1, 0, 1, 2)]), lambda d: F.least(F.greatest(F.col("center") + d, F.lit(L.EPS)), F.lit(1.0)))
        rows = units.filter("observed")
        rows = rows.withColumn("cluster", F.lit(0)) if labels is None else rows.join(labels.select("tumor_id", "mutation_id", "cluster"), ["tumor_id", "mutation_id"])
        rows = rows.join(centers.select("tumor_id", "cluster", "sample_id", F.col("beta").alias("center")), ["tumor_id", "cluster", "sample_id"])
        rows = rows.withColumn("beta", F.explode(F.array_distinct(near)))
        rows = rows.withColumn("loss", -L.log_sum_exp(L.log_terms(phi="beta")))
        centers = best_centers(rows.groupBy("tumor_id", "cluster", "sample_id", "beta").agg(F.sum("loss").alias("loss")))
    return centers


def assignment_cost(units: DataFrame, centers: DataFrame) -> DataFrame:
    """(tumor_id, mutation_id, cluster, cost): a mutation's loss at every cluster's centers; a unit's row holds its losses as an
    array."""
    every = centers.groupBy("tumor_id", "sample_id").agg(F.array_sort(F.collect_list(F.struct("cluster", "beta"))).alias("cs"))
    every = every.select("tumor_id", "sample_id", F.transform("cs", lambda c: c["cluster"]).alias("clusters"), F.transform("cs", lambda c: c["beta"].cast("double")).alias("betas"))
    rows = units.select("tumor_id", "sample_id", "mutation_id", "observed", "alt", "nonalt", "scaling", "paths").join(every, ["tumor_id", "sample_id"])
    rows = _with_losses(rows, ["tumor_id", "mutation_id", "observed", "clusters"], None)
    rows = rows.select("tumor_id", "mutation_id", "observed", F.explode(F.arrays_zip("clusters", "losses")).alias("l"))
    loss = F.when(F.col("observed"), F.col("l.losses")).otherwise(0.0)
    return rows.groupBy("tumor_id", "mutation_id", F.col("l.clusters").alias("cluster")).agg(F.sum(loss).alias("cost"))


def leave_one_out(labels: DataFrame, alpha: float = 1.0) -> DataFrame:
    """(tumor_id, mutation_id, cluster, log_weight): log share of each cluster among the other mutations, Dirichlet-smoothed."""
    sizes = labels.groupBy("tumor_id", "cluster").agg(F.count("*").alias("n_k"))
    totals = labels.groupBy("tumor_id").agg(F.count("*").alias("n"), F.countDistinct("cluster").alias("k"))
    rows = labels.select("tumor_id", "mutation_id", F.col("cluster").alias("own")).join(sizes, "tumor_id").join(totals, "tumor_id")
    left = F.col("n_k") - F.when(F.col("own") == F.col("cluster"), 1).otherwise(0)
    return rows.select("tumor_id", "mutation_id", "cluster", F.ln((left + alpha) / (F.col("n") - 1 + alpha * F.col("k"))).alias("log_weight"))


def reassigned(units: DataFrame, labels: DataFrame, centers: DataFrame, weight: float = 0.7, alpha: float = 1.0, decimals: int = 9) -> DataFrame:
    """(tumor_id, mutation_id, cluster, cost): each mutation's cheapest cluster, log weights included; ties to the first."""
    cost = assignment_cost(units, centers).join(leave_one_out(labels, alpha), ["tumor_id", "mutation_id", "cluster"])
    cost = cost.withColumn("total", F.round(F.col("cost") - weight * F.col("log_weight"), decimals))
    best = cost.groupBy("tumor_id", "mutation_id").agg(F.min(F.struct("total", "cluster")).alias("b"))
    return best.select("tumor_id", "mutation_id", F.col("b.cluster").alias("cluster"), F.col("b.total").alias("cost"))


def wells(grid: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(tumor_id, cluster, sample_id, first_beta, first_loss, second_beta, second_loss): the two lowest local minima of a loss
    grid, plateaus within the tolerance as one; second is null where there is one."""
    key = ["tumor_id", "cluster", "sample_id"]
    order = Window.partitionBy(*key).orderBy("beta")
    rows = grid.withColumn("r", F.round("loss", 9)).withColumn("new", F.when(F.abs(F.col("r") - F.lag("r").over(order)) <= tolerance, 0).otherwise(1))
    rows = rows.withColumn("block", F.sum("new").over(order))
    blocks = rows.groupBy(*key, "block").agg(F.min("beta").alias("beta"), F.min("r").alias("r"))
    by = Window.partitionBy(*key).orderBy("block")
    low = blocks.withColumns({"before": F.lag("r").over(by), "after": F.lead("r").over(by)}).filter((F.col("before").isNull() | (F.col("before") > F.col("r"))) & (F.col("after").isNull() | (F.col("after") > F.col("r"))))
    top = low.groupBy(*key).agg(F.slice(F.array_sort(F.collect_list(F.struct("r", "beta"))), 1, 2).alias("w"))
    second = F.get("w", F.lit(1))
    return top.select(*key, F.col("w")[0]["beta"].alias("first_beta"), F.col("w")[0]["r"].alias("first_loss"), second["beta"].alias("second_beta"), second["r"].alias("second_loss"))
