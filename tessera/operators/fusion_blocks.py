"""Whether a partition is what a fused profile says: blocks within a diameter of which no two could be one.

Each block is a box of its least and largest values by region, from one aggregate. The far corners of two boxes bound the furthest two
members from above, and the widest single region from below, since members attain each side of a box. Members meet only where
the tolerance lies between the two bounds, equal ones as one point.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import graph

#: Cells are a little wider than the tolerance, so that rounding loses no pair at exactly that distance.
SLACK = 1 + 1e-9


def points(profile: DataFrame, labels: DataFrame) -> DataFrame:
    """(tumor_id, cluster, phi, members): the different profiles of each block, phi an array by region."""
    rows = graph.vectors(profile).join(labels.select("tumor_id", "mutation_id", "cluster"), ["tumor_id", "mutation_id"])
    return rows.groupBy("tumor_id", "cluster", F.expr("transform(x, a -> a.phi)").alias("phi")).agg(F.count("*").alias("members"))


def boxes(profile: DataFrame, labels: DataFrame) -> DataFrame:
    """(tumor_id, cluster, lo, hi): arrays by region."""
    rows = profile.select("tumor_id", "mutation_id", "sample_id", "phi").join(labels.select("tumor_id", "mutation_id", "cluster"), ["tumor_id", "mutation_id"])
    sides = rows.groupBy("tumor_id", "cluster", "sample_id").agg(F.min("phi").alias("lo"), F.max("phi").alias("hi"))
    sides = sides.groupBy("tumor_id", "cluster").agg(F.array_sort(F.collect_list(F.struct("sample_id", "lo", "hi"))).alias("s"))
    return sides.select("tumor_id", "cluster", F.col("s.lo").alias("lo"), F.col("s.hi").alias("hi"))


def _bounds(rows: DataFrame, reach: str, tolerance: float) -> DataFrame:
    """With decided: whether the furthest two members are within the tolerance, null where the boxes don't tell."""
    rows = rows.withColumn("reach", F.expr(reach)).withColumns({"least": F.array_max("reach"), "most": F.expr("sqrt(aggregate(reach, 0D, (s, x) -> s + x * x))")})
    return rows.withColumn("decided", F.when(F.col("most") <= tolerance, True).when(F.col("least") > tolerance, False))


def box_pairs(found: DataFrame, tolerance: float) -> DataFrame:
    """(tumor_id, a, b, reach, decided): pairs of blocks that could be one. Their least values differ by the tolerance at most in every
    region, so boxes meet in cells that wide of the tumor's most spread region, equal or next ones, and not all with all."""
    axis = found.select("tumor_id", F.posexplode("lo").alias("i", "x")).groupBy("tumor_id", "i").agg(F.coalesce(F.stddev_pop("x"), F.lit(0.0)).alias("spread"))
    axis = axis.groupBy("tumor_id").agg(F.max_by("i", F.struct("spread", -F.col("i"))).alias("axis"))
    rows = found.join(axis, "tumor_id").withColumn("cell", F.floor(F.expr("lo[axis]") / (tolerance * SLACK)))
    left = rows.select("tumor_id", F.col("cluster").alias("c"), F.col("lo").alias("lo_c"), F.col("hi").alias("hi_c"), F.col("cell").alias("own"), F.explode(F.array(F.col("cell"), F.col("cell") + 1)).alias("cell"))
    right = rows.select("tumor_id", F.col("cluster").alias("d"), F.col("lo").alias("lo_d"), F.col("hi").alias("hi_d"), "cell")
    both = left.join(right, ["tumor_id", "cell"]).filter("own < cell OR c < d")
    reach = "zip_with(zip_with(hi_c, lo_d, (x, y) -> x - y), zip_with(hi_d, lo_c, (x, y) -> x - y), (x, y) -> greatest(x, y))"
    return _bounds(both, reach, tolerance).select("tumor_id", F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b"), "reach", "decided")


def _furthest(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(tumor_id, a, b, d, compared) of the given pairs of blocks, from their different points."""
    one = members.select("tumor_id", F.col("cluster").alias("a"), F.col("phi").alias("p"))
    two = members.select("tumor_id", F.col("cluster").alias("b"), F.col("phi").alias("q"))
    both = pairs.select("tumor_id", "a", "b").join(one, ["tumor_id", "a"]).join(two, ["tumor_id", "b"])
    d = F.expr("sqrt(aggregate(zip_with(p, q, (x, y) -> x - y), 0D, (s, x) -> s + x * x))")
    return both.groupBy("tumor_id", "a", "b").agg(F.max(d).alias("d"), F.count("*").alias("compared"))


def fusion_partition(profile: DataFrame, labels: DataFrame, tolerance: float, graphs: DataFrame | None = None) -> DataFrame:
    """One row a tumor of ``labels``: blocks, within (all diameters within the tolerance), mergeable (two blocks could be one within it),
    certified and reason; box_pairs and point_pairs are how many were joined.

    ``graphs`` may hold (tumor_id, graph_hash, certificate_hash): where the certificate's graph isn't the fit's, or there is none,
    the partition isn't certified. The first reason that holds counts: graph, diameter, merge. A profile with a null or NaN
    has no finite diameter and fails. Diameters compare whole blocks, so a chain of near members isn't one block.
    """
    members, found = points(profile, labels), boxes(profile, labels)
    own = _bounds(found, "zip_with(hi, lo, (x, y) -> x - y)", tolerance)
    bad = profile.groupBy("tumor_id").agg(F.bool_or(F.col("phi").isNull() | F.isnan("phi")).alias("bad"))
    inner = _furthest(members, own.filter("decided IS NULL").select("tumor_id", F.col("cluster").alias("a"), F.col("cluster").alias("b")))
    own = own.join(inner.select("tumor_id", F.col("a").alias("cluster"), "d", F.col("compared").alias("n")), ["tumor_id", "cluster"], "left")
    within = own.groupBy("tumor_id").agg(F.count("*").alias("blocks"), F.bool_and(F.coalesce("decided", F.col("d") <= tolerance, F.lit(False))).alias("within"), F.coalesce(F.sum("n"), F.lit(0)).alias("inner_pairs"))
    pairs = box_pairs(found, tolerance)
    outer = _furthest(members, pairs.filter("decided IS NULL"))
    cross = pairs.join(outer, ["tumor_id", "a", "b"], "left").groupBy("tumor_id").agg(F.count("*").alias("box_pairs"), F.bool_or(F.coalesce("decided", F.col("d") <= tolerance, F.lit(False))).alias("mergeable"), F.coalesce(F.sum("compared"), F.lit(0)).alias("outer_pairs"))
    out = labels.select("tumor_id").distinct().join(within, "tumor_id", "left").join(cross, "tumor_id", "left").join(bad, "tumor_id", "left")
    if graphs is not None:
        out = out.join(graphs.select("tumor_id", F.coalesce(F.col("graph_hash") == F.col("certificate_hash"), F.lit(False)).alias("same")), "tumor_id", "left")
    same = F.lit(True) if graphs is None else F.coalesce("same", F.lit(False))
    fits, merges = F.coalesce("within", F.lit(False)) & ~F.coalesce("bad", F.lit(False)), F.coalesce("mergeable", F.lit(False))
    reason = F.when(~same, "dense_certificate_graph_hash_mismatch").when(~fits, "raw_partition_chaining_or_solver_tolerance").when(merges, "mergeable_cross_block_pair_within_partition_tolerance").otherwise("none")
    return out.select("tumor_id", F.coalesce("blocks", F.lit(0)).alias("blocks"), fits.alias("within"), merges.alias("mergeable"), (reason == "none").alias("certified"), reason.alias("reason"), F.coalesce("box_pairs", F.lit(0)).alias("box_pairs"), (F.coalesce("inner_pairs", F.lit(0)) + F.coalesce("outer_pairs", F.lit(0))).alias("point_pairs"))
