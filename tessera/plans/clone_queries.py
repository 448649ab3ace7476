"""Queries over clone trees: each tumor of the cohort view gets a tree of seven clones, gains on its branches and its mutations'
places in them, all by rules of residues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import clones
from tessera.plans.cohort import PARTS, _r, query
from tessera.sources.cohort_view import REGIONS, long_table

N_CLONES, N_SEGMENTS, PURITY = 7, 10, 0.73

PARTS["tree"] = """tum AS (SELECT DISTINCT tumor_id FROM long),
tree AS (SELECT tumor_id, CAST(k AS INT) AS clone_id, CAST(CASE WHEN k = 0 THEN -1 ELSE (k - 1) // 2 END AS INT) AS parent_id FROM tum, range(0, 7) t(k)),
own AS (SELECT tumor_id, clone_id, sample_id, w / SUM(w) OVER (PARTITION BY tumor_id, sample_id) AS fraction FROM (
  SELECT tumor_id, clone_id, sample_id, CAST(1 + (clone_id * 7 + ascii(sample_id) + ascii(substr(tumor_id, 7, 1))) % 5 AS DOUBLE) AS w FROM tree, (SELECT DISTINCT sample_id FROM long))),
line AS (SELECT a.tumor_id, a.clone_id, b.clone_id AS below FROM tree a JOIN tree b ON a.tumor_id = b.tumor_id AND (a.clone_id = b.clone_id OR a.clone_id = b.parent_id OR a.clone_id = 0)),
cells AS (SELECT l.tumor_id, l.clone_id, o.sample_id, SUM(o.fraction) AS ccf FROM line l JOIN own o ON o.tumor_id = l.tumor_id AND o.clone_id = l.below GROUP BY ALL),
event AS (SELECT tumor_id, CAST(e AS INT) AS event_id, CAST((e * 3 + 1) % 7 AS INT) AS clone_id, CAST(e * 2 % 10 AS INT) AS segment_id, CAST((e * 13) % 10 AS DOUBLE) / 10 AS branch_time FROM tum, range(0, 6) t(e)),
copies AS (SELECT t.tumor_id, t.clone_id, CAST(s AS INT) AS segment_id, CAST(1 + COUNT(e.event_id) FILTER (e.event_id % 2 = 0) AS INT) AS allele_a_cn, CAST(1 + COUNT(e.event_id) FILTER (e.event_id % 2 = 1) AS INT) AS allele_b_cn
  FROM tree t CROSS JOIN range(0, 10) r(s) LEFT JOIN (SELECT e.*, l.below FROM event e JOIN line l ON l.tumor_id = e.tumor_id AND l.clone_id = e.clone_id) e ON e.tumor_id = t.tumor_id AND e.below = t.clone_id AND e.segment_id = s GROUP BY t.tumor_id, t.clone_id, s),
mut AS (SELECT DISTINCT tumor_id, mutation_id, CAST(mutation_id % 7 AS INT) AS clone_id, CAST(mutation_id // 7 % 10 AS INT) AS segment_id, CAST((mutation_id * 17) % 10 AS DOUBLE) / 10 AS branch_time FROM long),
dose AS (SELECT m.tumor_id, m.mutation_id, m.segment_id, t.clone_id, CASE WHEN l.below IS NULL THEN 0 WHEN m.branch_time < 5e-1 THEN c.allele_a_cn ELSE 1 END AS dosage
  FROM mut m JOIN tree t USING (tumor_id) LEFT JOIN line l ON l.tumor_id = m.tumor_id AND l.clone_id = m.clone_id AND l.below = t.clone_id JOIN copies c ON c.tumor_id = m.tumor_id AND c.clone_id = t.clone_id AND c.segment_id = m.segment_id),
ident AS (SELECT tumor_id, clone_id, CAST(dense_rank() OVER (PARTITION BY tumor_id ORDER BY first) - 1 AS INT) AS cn_clone_id FROM (
  SELECT *, MIN(clone_id) OVER (PARTITION BY tumor_id, p) AS first FROM (SELECT tumor_id, clone_id, string_agg(segment_id || ':' || allele_a_cn || ',' || allele_b_cn, ';' ORDER BY segment_id) AS p FROM copies GROUP BY ALL)))"""
TREE = ("long", "tree")


def tables(spark, sf_dir) -> dict[str, DataFrame]:
    """tree, cells, events, copies, mutations, dosage of the cohort."""
    long = long_table(spark, sf_dir)
    tumors = long.select("tumor_id").distinct()
    tree = tumors.withColumn("clone_id", F.explode(F.sequence(F.lit(0), F.lit(N_CLONES - 1))))
    tree = tree.withColumn("parent_id", F.when(F.col("clone_id") == 0, -1).otherwise(F.expr("(clone_id - 1) div 2")).cast("int"))
    line = clones.descendants(tree)
    weight = (1 + (F.col("clone_id") * 7 + F.ascii("sample_id") + F.ascii(F.substring("tumor_id", 7, 1))) % 5).cast("double")
    own = tree.withColumn("sample_id", F.explode(F.array(*map(F.lit, REGIONS)))).withColumn("w", weight)
    own = own.join(own.groupBy("tumor_id", "sample_id").agg(F.sum("w").alias("total")), ["tumor_id", "sample_id"]).select("tumor_id", F.col("clone_id").alias("below"), "sample_id", (F.col("w") / F.col("total")).alias("f"))
    cells = line.join(own, ["tumor_id", "below"]).groupBy("tumor_id", "clone_id", "sample_id").agg(F.sum("f").alias("ccf"))
    e = F.col("event_id")
    events = tumors.withColumn("event_id", F.explode(F.sequence(F.lit(0), F.lit(5)))).select("tumor_id", "event_id", ((e * 3 + 1) % N_CLONES).alias("clone_id"), (e * 2 % N_SEGMENTS).alias("segment_id"), (((e * 13) % 10).cast("double") / 10).alias("branch_time"))
    gains = events.join(line, ["tumor_id", "clone_id"]).groupBy("tumor_id", F.col("below").alias("clone_id"), "segment_id").agg(F.count_if(F.col("event_id") % 2 == 0).alias("a"), F.count_if(F.col("event_id") % 2 == 1).alias("b"))
    copies = tree.select("tumor_id", "clone_id", F.explode(F.sequence(F.lit(0), F.lit(N_SEGMENTS - 1))).alias("segment_id")).join(gains, ["tumor_id", "clone_id", "segment_id"], "left")
    copies = copies.select("tumor_id", "clone_id", "segment_id", *[(1 + F.coalesce(x, F.lit(0))).cast("int").alias(f"allele_{x}_cn") for x in "ab"])
    m = F.col("mutation_id")
    mutations = long.select("tumor_id", "mutation_id").distinct().select("tumor_id", "mutation_id", (m % N_CLONES).cast("int").alias("clone_id"), F.expr(f"mutation_id div {N_CLONES} % {N_SEGMENTS}").cast("int").alias("segment_id"), (((m * 17) % 10).cast("double") / 10).alias("branch_time"))
    at = mutations.withColumnRenamed("clone_id", "origin").withColumn("clone_id", F.explode(F.sequence(F.lit(0), F.lit(N_CLONES - 1))))
    at = at.join(line.select("tumor_id", F.col("clone_id").alias("origin"), F.col("below").alias("clone_id"), F.lit(True).alias("has")), ["tumor_id", "origin", "clone_id"], "left").join(copies, ["tumor_id", "clone_id", "segment_id"])
    dosage = at.select("tumor_id", "mutation_id", "segment_id", "clone_id", F.when(F.col("has").isNull(), 0).when(F.col("branch_time") < 0.5, F.col("allele_a_cn")).otherwise(1).alias("dosage"))
    return {"tree": tree, "line": line, "cells": cells, "events": events, "copies": copies, "mutations": mutations, "dosage": dosage}


@query(TREE, "SELECT tumor_id, clone_id, below FROM line")
def clone_descendants(spark, sf_dir):
    return tables(spark, sf_dir)["line"]


@query(TREE, "SELECT tumor_id, clone_id, sample_id, round(fraction, 6) AS fraction FROM own")
def exclusive_fractions(spark, sf_dir):
    t = tables(spark, sf_dir)
    return clones.exclusive_fractions(t["tree"], t["cells"]).withColumn("fraction", _r("fraction"))


@query(TREE, """SELECT c.tumor_id, c.clone_id, cn_clone_id, c.segment_id, 1 AS chromosome, CAST(c.segment_id AS BIGINT) * 1000000 + 1 AS start, (CAST(c.segment_id AS BIGINT) + 1) * 1000000 AS "end", allele_a_cn, allele_b_cn,
  greatest(allele_a_cn, allele_b_cn) AS major_cn, least(allele_a_cn, allele_b_cn) AS minor_cn, allele_a_cn + allele_b_cn AS total_cn FROM copies c JOIN ident USING (tumor_id, clone_id)""")  # fmt: skip
def clone_cn_profiles(spark, sf_dir):
    t = tables(spark, sf_dir)
    return clones.profile_table(t["copies"], clones.profile_ids(t["copies"]), clones.genome(spark, N_SEGMENTS))


@query(TREE, "SELECT tumor_id, cn_clone_id, sample_id, round(SUM(fraction), 6) AS fraction FROM own JOIN ident USING (tumor_id, clone_id) GROUP BY ALL")
def cn_clone_fractions(spark, sf_dir):
    t = tables(spark, sf_dir)
    return clones.profile_fractions(clones.exclusive_fractions(t["tree"], t["cells"]), clones.profile_ids(t["copies"])).withColumn("fraction", _r("fraction"))


@query(TREE, """SELECT tumor_id, sample_id, segment_id, allele_a_cn, allele_b_cn, round(SUM(fraction), 6) AS fraction, string_agg(DISTINCT CAST(clone_id AS VARCHAR), ',' ORDER BY CAST(clone_id AS VARCHAR)) AS clones FROM copies JOIN own USING (tumor_id, clone_id) GROUP BY ALL""")
def local_states(spark, sf_dir):
    t = tables(spark, sf_dir)
    out = clones.local_states(t["copies"], clones.exclusive_fractions(t["tree"], t["cells"]))
    return out.withColumns({"fraction": _r("fraction"), "clones": F.array_join(F.transform("clones", lambda c: c.cast("string")), ",")})


@query(TREE, "SELECT tumor_id, sample_id, segment_id, greatest(allele_a_cn, allele_b_cn) AS allele_a_cn, least(allele_a_cn, allele_b_cn) AS allele_b_cn, round(SUM(fraction), 6) AS fraction FROM copies JOIN own USING (tumor_id, clone_id) GROUP BY ALL HAVING SUM(fraction) > 1e-1")
def unphased_states(spark, sf_dir):
    t = tables(spark, sf_dir)
    return clones.local_states(t["copies"], clones.exclusive_fractions(t["tree"], t["cells"]), phased=False, least=0.1).withColumn("fraction", _r("fraction")).drop("clones")


PARTS["truth"] = """truth AS (SELECT d.tumor_id, d.mutation_id, o.sample_id, SUM(CASE WHEN dosage > 0 THEN fraction ELSE 0 END) AS ccf, SUM(dosage * fraction) AS mass, SUM((allele_a_cn + allele_b_cn) * fraction) AS total
  FROM dose d JOIN copies c ON c.tumor_id = d.tumor_id AND c.clone_id = d.clone_id AND c.segment_id = d.segment_id JOIN own o ON o.tumor_id = d.tumor_id AND o.clone_id = d.clone_id GROUP BY ALL)"""


@query((*TREE, "truth"), """SELECT tumor_id, mutation_id, sample_id, round(ccf, 6) AS ccf, round(mass, 6) AS mutant_copy_mass, round(total, 6) AS mean_total_cn, round(mass / ccf, 6) AS effective_multiplicity,
  round(73e-2 * mass / (73e-2 * total + (1 - 73e-2) * 2), 6) AS expected_vaf FROM truth""")  # fmt: skip
def mutation_truth(spark, sf_dir):
    t = tables(spark, sf_dir)
    out = clones.mutation_truth(t["dosage"], clones.exclusive_fractions(t["tree"], t["cells"]), t["copies"], PURITY)
    return out.withColumns({c: _r(c) for c in ("ccf", "mutant_copy_mass", "mean_total_cn", "effective_multiplicity", "expected_vaf")})


PARTS["timed"] = """timed AS (SELECT m.tumor_id, m.mutation_id, e.event_id, CASE WHEN m.clone_id = e.clone_id THEN m.branch_time < e.branch_time WHEN d.below IS NOT NULL THEN TRUE WHEN u.below IS NOT NULL THEN FALSE END AS precedes
  FROM mut m JOIN event e ON e.tumor_id = m.tumor_id AND e.segment_id = m.segment_id LEFT JOIN line d ON d.tumor_id = m.tumor_id AND d.clone_id = m.clone_id AND d.below = e.clone_id LEFT JOIN line u ON u.tumor_id = m.tumor_id AND u.clone_id = e.clone_id AND u.below = m.clone_id)"""


@query((*TREE, "timed"), "SELECT tumor_id, mutation_id, event_id, precedes FROM timed WHERE precedes IS NOT NULL")
def gain_timing(spark, sf_dir):
    t = tables(spark, sf_dir)
    return clones.timing(t["mutations"], t["events"], t["line"])


@query((*TREE, "timed"), """SELECT tumor_id, COALESCE(n_pairs, 0) AS n_pairs, round(COALESCE(b, 0) / greatest(COALESCE(n_pairs, 0), 1), 6) AS before_share, round((COALESCE(n_pairs, 0) - COALESCE(b, 0)) / greatest(COALESCE(n_pairs, 0), 1), 6) AS after_share,
  round(COALESCE(mb, 0) / n, 6) AS mutations_before, round(COALESCE(ma, 0) / n, 6) AS mutations_after FROM (SELECT tumor_id, COUNT(DISTINCT mutation_id) AS n FROM mut GROUP BY tumor_id)
  LEFT JOIN (SELECT tumor_id, COUNT(*) AS n_pairs, COUNT(*) FILTER (precedes) AS b, COUNT(DISTINCT mutation_id) FILTER (precedes) AS mb, COUNT(DISTINCT mutation_id) FILTER (NOT precedes) AS ma FROM timed WHERE precedes IS NOT NULL GROUP BY tumor_id) USING (tumor_id)""")  # fmt: skip
def gain_timing_summary(spark, sf_dir):
    t = tables(spark, sf_dir)
    out = clones.timing_summary(clones.timing(t["mutations"], t["events"], t["line"]), t["mutations"])
    return out.withColumns({c: _r(c) for c in ("before_share", "after_share", "mutations_before", "mutations_after")})


PARTS["states"] = "states AS (SELECT tumor_id, segment_id, COUNT(DISTINCT greatest(allele_a_cn, allele_b_cn) * 100 + least(allele_a_cn, allele_b_cn)) AS n_states, bool_or(allele_a_cn <> 1 OR allele_b_cn <> 1) AS altered FROM copies GROUP BY ALL)"


@query((*TREE, "states"), """SELECT tumor_id, bucket, COUNT(*) AS n, round(COUNT(*) / MAX(total), 6) AS share FROM (SELECT tumor_id, CASE WHEN n_states >= 3 THEN '3_plus' ELSE CAST(n_states AS VARCHAR) END AS bucket, COUNT(*) OVER (PARTITION BY tumor_id) AS total
  FROM mut JOIN states USING (tumor_id, segment_id)) GROUP BY tumor_id, bucket""")  # fmt: skip
def state_histogram(spark, sf_dir):
    t = tables(spark, sf_dir)
    return clones.histogram(t["mutations"].join(clones.state_counts(t["copies"]), ["tumor_id", "segment_id"]), "n_states", 3).withColumn("share", _r("share"))


@query(TREE, """SELECT tumor_id, round(MIN(e), 6) AS minimum, round(AVG(e), 6) AS mean, round(MAX(e), 6) AS maximum FROM (SELECT tumor_id, sample_id, -SUM(f * ln(f)) AS e FROM (
  SELECT tumor_id, cn_clone_id, sample_id, SUM(fraction) AS f FROM own JOIN ident USING (tumor_id, clone_id) GROUP BY ALL) GROUP BY ALL) GROUP BY tumor_id""")  # fmt: skip
def cn_entropy(spark, sf_dir):
    t = tables(spark, sf_dir)
    fractions = clones.profile_fractions(clones.exclusive_fractions(t["tree"], t["cells"]), clones.profile_ids(t["copies"]))
    return clones.spread(clones.profile_entropy(fractions), "entropy").withColumns({c: _r(c) for c in ("minimum", "mean", "maximum")})


@query((*TREE, "truth", "states"), """SELECT a.tumor_id, round(a.altered_segment_fraction, 6) AS altered_segment_fraction, a.maximum_local_state_count, b.maximum_allele_cn, c.whole_genome_cn_clone_count, d.applied_cna_event_count,
  round(e.x, 6) AS fraction_mutations_on_altered_segments, f.maximum_clone_specific_dosage, round(f.y, 6) AS fraction_mutations_with_dosage_gt_one, round(g.z, 6) AS fraction_noninteger_effective_multiplicity
  FROM (SELECT tumor_id, AVG(CAST(altered AS INT)) AS altered_segment_fraction, MAX(n_states) AS maximum_local_state_count FROM states GROUP BY tumor_id) a
  JOIN (SELECT tumor_id, MAX(greatest(allele_a_cn, allele_b_cn)) AS maximum_allele_cn FROM copies GROUP BY tumor_id) b USING (tumor_id)
  JOIN (SELECT tumor_id, COUNT(DISTINCT cn_clone_id) AS whole_genome_cn_clone_count FROM ident GROUP BY tumor_id) c USING (tumor_id)
  JOIN (SELECT tumor_id, COUNT(DISTINCT event_id) AS applied_cna_event_count FROM event GROUP BY tumor_id) d USING (tumor_id)
  JOIN (SELECT tumor_id, AVG(CAST(altered AS INT)) AS x FROM mut JOIN states USING (tumor_id, segment_id) GROUP BY tumor_id) e USING (tumor_id)
  JOIN (SELECT tumor_id, MAX(m) AS maximum_clone_specific_dosage, AVG(CAST(m > 1 AS INT)) AS y FROM (SELECT tumor_id, mutation_id, MAX(dosage) AS m FROM dose GROUP BY ALL) GROUP BY tumor_id) f USING (tumor_id)
  JOIN (SELECT tumor_id, AVG(CAST(abs(mass / ccf - round(mass / ccf)) > 1e-8 AS INT)) AS z FROM truth GROUP BY tumor_id) g USING (tumor_id)""")  # fmt: skip
def cn_complexity(spark, sf_dir):
    t = tables(spark, sf_dir)
    truth = clones.mutation_truth(t["dosage"], clones.exclusive_fractions(t["tree"], t["cells"]), t["copies"], PURITY)
    out = clones.complexity(t["copies"], clones.profile_ids(t["copies"]), t["mutations"], t["events"], truth, t["dosage"])
    return out.withColumns({c: _r(c) for c in ("altered_segment_fraction", "fraction_mutations_on_altered_segments", "fraction_mutations_with_dosage_gt_one", "fraction_noninteger_effective_multiplicity")})


@query(TREE, """SELECT tumor_id, sample_id, clone_id, rule FROM (SELECT c.tumor_id, c.sample_id, c.clone_id, c.parent_id, c.x, p.x AS px, k.x AS kx, l.x AS lx FROM
    (SELECT *, ccf + CASE WHEN clone_id = 3 AND sample_id = 'A' THEN 1e0 WHEN clone_id = 0 AND sample_id = 'N' THEN -25e-2 ELSE 0 END AS x FROM cells JOIN tree USING (tumor_id, clone_id)) c
    LEFT JOIN (SELECT tumor_id, clone_id, sample_id, ccf + CASE WHEN clone_id = 3 AND sample_id = 'A' THEN 1e0 WHEN clone_id = 0 AND sample_id = 'N' THEN -25e-2 ELSE 0 END AS x FROM cells) p ON p.tumor_id = c.tumor_id AND p.sample_id = c.sample_id AND p.clone_id = c.parent_id
    LEFT JOIN (SELECT tumor_id, parent_id AS clone_id, sample_id, SUM(ccf + CASE WHEN clone_id = 3 AND sample_id = 'A' THEN 1e0 ELSE 0 END) AS x FROM cells JOIN tree USING (tumor_id, clone_id) WHERE parent_id >= 0 GROUP BY ALL) k ON k.tumor_id = c.tumor_id AND k.sample_id = c.sample_id AND k.clone_id = c.clone_id
    LEFT JOIN (SELECT line.tumor_id, line.clone_id, sample_id, SUM(ccf + CASE WHEN below = 3 AND sample_id = 'A' THEN 1e0 ELSE 0 END) AS x FROM line JOIN cells ON cells.tumor_id = line.tumor_id AND cells.clone_id = line.below WHERE below >= 3 GROUP BY ALL) l ON l.tumor_id = c.tumor_id AND l.sample_id = c.sample_id AND l.clone_id = c.clone_id),
  (VALUES ('root is not 1'), ('outside [0, 1]'), ('above its parent'), ('below its children'), ('below its leaves')) v(rule)
  WHERE CASE rule WHEN 'root is not 1' THEN parent_id < 0 AND abs(x - 1) > 1e-8 WHEN 'outside [0, 1]' THEN x < -1e-8 OR x > 1 + 1e-8 WHEN 'above its parent' THEN x > px + 1e-8 WHEN 'below its children' THEN x - COALESCE(kx, 0) < -1e-8 ELSE lx > x + 1e-8 END""")  # fmt: skip
def tree_violations(spark, sf_dir):
    t = tables(spark, sf_dir)
    moved = F.when((F.col("clone_id") == 3) & (F.col("sample_id") == "A"), 1.0).when((F.col("clone_id") == 0) & (F.col("sample_id") == "N"), -0.25).otherwise(0.0)
    return clones.violations(t["tree"], t["cells"].withColumn("ccf", F.col("ccf") + moved))
