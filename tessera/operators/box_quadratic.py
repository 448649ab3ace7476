"""The exact box quadratic of a complete graph, region by region, by running sums over where its members meet their bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def solved(units: DataFrame, rho: float) -> DataFrame:
    """(tumor_id, mutation_id, sample_id, x): x in the box with (h + rho m) x = target + rho sum(x), m the tumor's mutations.

    ``units`` are (tumor_id, mutation_id, sample_id, target, h, lower, upper), h >= 0 and ``rho`` > 0. Given the sum, each x is a
    clipped line; a member leaves its lower bound at one value of the sum and meets its upper one at another. Between neighbours of
    these the right side is one line, whose slope and height are running sums; it falls below the sum once, and the root
    is on the line after the last value that it isn't below. Equal bounds and ties are events at one value.
    """
    key = ["tumor_id", "sample_id"]
    base = units.groupBy(*key).agg(F.count("*").alias("m"), F.sum("lower").alias("lowest"))
    rows = units.join(base, key).withColumn("d", F.col("h") + rho * F.col("m"))
    leave = F.struct(((F.col("d") * F.col("lower") - F.col("target")) / rho).alias("at"), F.lit(0).alias("kind"), (rho / F.col("d")).alias("slope"), (F.col("target") / F.col("d") - F.col("lower")).alias("height"))
    meet = F.struct(((F.col("d") * F.col("upper") - F.col("target")) / rho).alias("at"), F.lit(1).alias("kind"), (-rho / F.col("d")).alias("slope"), (F.col("upper") - F.col("target") / F.col("d")).alias("height"))
    events = rows.select(*key, "mutation_id", "lowest", F.inline(F.array(leave, meet)))
    run = Window.partitionBy(*key).orderBy("at", "mutation_id", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = events.select(*key, "lowest", "at", F.sum("slope").over(run).alias("slope"), F.sum("height").over(run).alias("height"), F.row_number().over(Window.partitionBy(*key).orderBy("at", "mutation_id", "kind")).alias("i"))
    above = lines.filter(F.col("lowest") + F.col("height") + (F.col("slope") - 1.0) * F.col("at") >= 0)
    root = above.groupBy(*key).agg(F.max_by(F.struct("lowest", "slope", "height"), "i").alias("l")).select(*key, ((F.col("l.lowest") + F.col("l.height")) / (1.0 - F.col("l.slope"))).alias("total"))
    out = rows.join(root, key, "left").withColumn("total", F.coalesce("total", "lowest"))
    x = F.least(F.greatest((F.col("target") + rho * F.col("total")) / F.col("d"), F.col("lower")), F.col("upper"))
    return out.select("tumor_id", "mutation_id", "sample_id", x.alias("x"))
