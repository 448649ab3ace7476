"""Connected components of an edge table, without collecting it: alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation on edges (u, v). Large: larger neighbours go to the least of the closed neighbourhood;
    small: the node and its smaller neighbours do. ``min`` combines map-side, so a hub costs one row a task."""
    if large:
        near = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = near.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Rows (node, component): ``component`` is the least node id reachable from ``node``.

    ``edges`` has integer columns u and v in any order; self-loops, repeats and null ends are ignored and only nodes with
    an edge are returned. Each round is written to the shared folder; the rounds needed grow with the logarithm of the
    longest path. Raises if the rounds given do not suffice, rather than return split components.
    """
    now = written(
        edges.filter("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "edges",
    )
    mark = None
    for _ in range(max_rounds):
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
        if not seen[0]:
            break
        now = written(_star(_star(now, large=True), large=False), "edges")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
