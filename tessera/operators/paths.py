"""Paths of a mutation through copy-number states, compiled once for each set of states that occurs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PENALTY = 3.0


def _upto(n):
    """1..n, empty for n < 1 (a plain sequence would count down)."""
    return F.when(n >= 1, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))


def compiled(state_sets: DataFrame, penalty: float = PENALTY, phased: bool = False) -> DataFrame:
    """(states, paths): for every distinct array of states (a, b, f), its paths sorted by (switch, first, second), each with
    the log of its prior. The prior of a mapping falls with the copies it adds; mappings that give one path are added up.
    Sets of more than two states, and of none with copies, have no paths."""

    def step(d1, d2, switch):
        return F.struct(F.when(d1 == d2, F.lit(1.0)).otherwise(switch).alias("switch"), d1.cast("double").alias("first"), d2.cast("double").alias("second"))

    s1, s2 = F.col("states")[0], F.get(F.col("states"), F.lit(1))
    one = F.flatten(F.transform(F.array(s1["a"], s1["b"]), lambda n: F.transform(_upto(n), lambda d: step(d, d, F.lit(1.0)))))
    pairs = [(s1["a"], s2["a"]), (s1["b"], s2["b"])] + ([] if phased else [(s1["a"], s2["b"]), (s1["b"], s2["a"])])

    def both(n1, n2):
        return F.flatten(F.transform(_upto(n1), lambda d1: F.flatten(F.transform(_upto(n2), lambda d2: F.array(step(d1, d2, s1["f"]), step(d2, d1, s2["f"]))))))

    two = F.flatten(F.array(*[both(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))) for x, y in pairs]))
    some = state_sets.select("states").distinct().withColumn("p", F.explode(F.when(F.size("states") == 1, one).when(F.size("states") == 2, two)))
    extra = F.greatest(F.col("p.first") * F.col("p.switch") + F.col("p.second") * (1.0 - F.col("p.switch")) - 1.0, F.lit(0.0))
    mass = some.groupBy("states", "p").agg(F.sum(F.exp(-penalty * extra)).alias("w"))
    total = mass.groupBy("states").agg(F.sum("w").alias("total"), F.collect_list(F.struct("p", "w")).alias("all"))
    path = F.transform("all", lambda x: F.struct(x["p"]["switch"].alias("switch"), x["p"]["first"].alias("first"), x["p"]["second"].alias("second"), F.ln(x["w"] / F.col("total")).alias("log_prior")))
    return total.select("states", F.array_sort(path).alias("paths"))


def with_paths(units: DataFrame, penalty: float = PENALTY, phased: bool = False) -> DataFrame:
    """Units with their paths; units whose states have none get one dummy path of one copy, and are not observed."""
    table = compiled(units.select("states"), penalty, phased)
    dummy = F.array(F.struct(F.lit(1.0).alias("switch"), F.lit(1.0).alias("first"), F.lit(1.0).alias("second"), F.lit(0.0).alias("log_prior")))
    return units.join(table, "states", "left").withColumn("paths", F.coalesce("paths", dummy))


def legacy_paths(major_prior: float = 0.5):
    """The one-state mixture as paths: the low multiplicity and, where it is ambiguous, the major one."""
    low, major = F.col("multiplicity_low").cast("double"), F.col("major_cn").cast("double")

    def path(copies, log_prior):
        return F.struct(F.lit(0.0).alias("switch"), copies.alias("first"), copies.alias("second"), log_prior.alias("log_prior"))

    import math

    two = F.array(path(low, F.lit(math.log(1 - major_prior))), path(major, F.lit(math.log(major_prior))))
    return F.when(F.col("multiplicity_estimated"), two).otherwise(F.array(path(major, F.lit(0.0))))


def fixed_linear(paths="paths"):
    """Whether all paths of a unit have one and the same slope."""
    p = F.col(paths)
    return F.forall(p, lambda x: (x["first"] == x["second"]) & (x["first"] == p[0]["first"]))
