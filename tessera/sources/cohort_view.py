"""The cohort of tumors in the driver's tables: brands are tumors, parts mutations, return flags regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATES = [(0, "s1", 1.0, 1, 1), (1, "s1", 0.4, 1, 1), (1, "s2", 0.6, 2, 1), (2, "s1", 0.3, 1, 1), (2, "s2", 0.7, 2, 2)]
LEAST_DEPTH = 40
#: The regions of the view: the return flags.
REGIONS = ("A", "N", "R")


def long_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical long table: one row for each mutation, region and local copy-number state."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_brand", "p_partkey", "p_size")
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_returnflag", "l_discount", "l_quantity")
    thr = F.element_at(F.array(F.lit(5), F.lit(7), F.lit(8), F.lit(10)), (F.col("mutation_id") % 4 + 1).cast("int"))
    high, n = F.round(F.col("l_discount") * 100).cast("int") >= thr, F.col("l_quantity").cast("int")
    # counts by mutation and region first: the fact table is shuffled once, after partial sums
    counts = line.select(F.col("l_partkey").alias("mutation_id"), F.col("l_returnflag").alias("sample_id"), "l_discount", "l_quantity")
    counts = counts.groupBy("mutation_id", "sample_id").agg(F.sum(F.when(high, n).otherwise(0)).alias("alt"), F.sum(F.when(high, 0).otherwise(n)).alias("ref"))
    regions = line.select(F.col("l_returnflag").alias("sample_id")).distinct().agg(F.collect_set("sample_id").alias("regions"))  # one row
    units = part.select(F.col("p_brand").alias("tumor_id"), F.col("p_partkey").alias("mutation_id"), F.col("p_size").alias("segment_id")).join(F.broadcast(regions))
    units = units.select("tumor_id", "mutation_id", "segment_id", F.explode("regions").alias("sample_id")).join(counts, ["mutation_id", "sample_id"], "left")
    seen = F.coalesce(F.col("alt") + F.col("ref"), F.lit(0)) >= LEAST_DEPTH
    states = F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(s).alias("cn_state_id"), F.lit(f).alias("cn_state_fraction"), F.lit(a).alias("allele_a_cn"), F.lit(b).alias("allele_b_cn")) for k, s, f, a, b in STATES]), lambda s: s["kind"] == F.col("segment_id") % 3)
    return units.select(
        "tumor_id", "mutation_id", "sample_id", F.when(seen, F.col("alt")).alias("alt_count"), F.when(seen, F.col("ref")).alias("ref_count"), seen.alias("count_observed"),
        F.when(F.col("sample_id") == "A", 0.8).when(F.col("sample_id") == "N", 0.7).otherwise(0.6).alias("purity"), F.lit(2.0).alias("normal_cn"), "segment_id", F.explode(states).alias("s"),
    ).select("tumor_id", "mutation_id", "sample_id", "alt_count", "ref_count", "count_observed", "purity", "normal_cn", "segment_id", "s.cn_state_id", "s.cn_state_fraction", "s.allele_a_cn", "s.allele_b_cn")


#: The same table in DuckDB, as a chain of common table expressions.
LONG_SQL = """flags AS (SELECT DISTINCT l_returnflag AS sample_id FROM lineitem),
units0 AS (SELECT p.p_brand AS tumor_id, p.p_partkey AS mutation_id, f.sample_id, p.p_size AS segment_id,
  CASE p.p_partkey % 4 WHEN 0 THEN 5 WHEN 1 THEN 7 WHEN 2 THEN 8 ELSE 10 END AS thr FROM part p CROSS JOIN flags f),
counts0 AS (SELECT u.tumor_id, u.mutation_id, u.sample_id,
  CAST(SUM(CASE WHEN CAST(ROUND(l.l_discount * 100) AS INT) >= u.thr THEN CAST(l.l_quantity AS INT) ELSE 0 END) AS BIGINT) AS alt_count,
  CAST(SUM(CASE WHEN CAST(ROUND(l.l_discount * 100) AS INT) < u.thr THEN CAST(l.l_quantity AS INT) ELSE 0 END) AS BIGINT) AS ref_count
  FROM units0 u JOIN lineitem l ON l.l_partkey = u.mutation_id AND l.l_returnflag = u.sample_id GROUP BY u.tumor_id, u.mutation_id, u.sample_id),
states0(kind, cn_state_id, cn_state_fraction, allele_a_cn, allele_b_cn) AS (
  VALUES (0, 's1', 1e0, 1, 1), (1, 's1', 4e-1, 1, 1), (1, 's2', 6e-1, 2, 1), (2, 's1', 3e-1, 1, 1), (2, 's2', 7e-1, 2, 2)),
long AS (SELECT u.tumor_id, u.mutation_id, u.sample_id,
  CASE WHEN COALESCE(c.alt_count + c.ref_count, 0) >= 40 THEN c.alt_count END AS alt_count,
  CASE WHEN COALESCE(c.alt_count + c.ref_count, 0) >= 40 THEN c.ref_count END AS ref_count,
  COALESCE(c.alt_count + c.ref_count, 0) >= 40 AS count_observed,
  CASE u.sample_id WHEN 'A' THEN 8e-1 WHEN 'N' THEN 7e-1 ELSE 6e-1 END AS purity,
  2e0 AS normal_cn, u.segment_id, s.cn_state_id, s.cn_state_fraction, s.allele_a_cn, s.allele_b_cn
  FROM units0 u JOIN states0 s ON s.kind = u.segment_id % 3
  LEFT JOIN counts0 c ON c.tumor_id = u.tumor_id AND c.mutation_id = u.mutation_id AND c.sample_id = u.sample_id)"""
