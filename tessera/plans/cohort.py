"""Queries over the cohort view of the driver's tables, with the SQL that gives the same rows.

Every query starts from ``cohort_view.long_table``. ``profile`` and ``labels`` stand for a fit: a deterministic profile of phi
and a partition of each tumor's mutations into four clusters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import likelihood as L
from tessera.operators import copynumber as cn
from tessera.operators import graph, kkt, partitions, paths, refit, scores, validate
from tessera.sources.cohort_view import LONG_SQL, REGIONS, long_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Named parts of the SQL; a query lists the last one it needs and gets those before it.
PARTS: dict[str, str] = {"long": LONG_SQL}
PARTS["merged"] = """merged AS (SELECT tumor_id, sample_id, segment_id, a, b, SUM(f) AS fraction FROM (
  SELECT DISTINCT tumor_id, sample_id, segment_id, cn_state_id, cn_state_fraction AS f, allele_a_cn AS a, allele_b_cn AS b FROM long)
  GROUP BY tumor_id, sample_id, segment_id, a, b)"""
PARTS["seg"] = """seg AS (SELECT tumor_id, sample_id, segment_id, SUM(fraction * (a + b)) AS mean_cn, bool_or(a <> 1 OR b <> 1) AS has_cna, COUNT(*) AS n_states,
  arg_max(greatest(a, b), fraction * 1000000 + (a + b) * 1000 + a) AS major_cn, arg_max(least(a, b), fraction * 1000000 + (a + b) * 1000 + a) AS minor_cn
  FROM merged GROUP BY tumor_id, sample_id, segment_id)"""
PARTS["unit"] = """unit AS (SELECT u.*, s.mean_cn, s.has_cna, s.n_states, s.major_cn, s.minor_cn, u.purity / ((1 - u.purity) * u.normal_cn + u.purity * s.mean_cn) AS c,
  CASE WHEN u.count_observed THEN CAST(u.alt_count AS DOUBLE) ELSE 0e0 END AS alt, CASE WHEN u.count_observed THEN CAST(u.ref_count AS DOUBLE) ELSE 0e0 END AS nonalt
  FROM (SELECT DISTINCT tumor_id, mutation_id, sample_id, alt_count, ref_count, count_observed, purity, normal_cn, segment_id FROM long) u JOIN seg s USING (tumor_id, sample_id, segment_id))"""
PARTS["path"] = """two AS (SELECT x.tumor_id, x.sample_id, x.segment_id, x.a AS a1, x.b AS b1, x.fraction AS f1, y.a AS a2, y.b AS b2, y.fraction AS f2
  FROM merged x JOIN merged y ON x.tumor_id = y.tumor_id AND x.sample_id = y.sample_id AND x.segment_id = y.segment_id AND (x.a < y.a OR (x.a = y.a AND x.b < y.b))),
cand AS (
  SELECT m.tumor_id, m.sample_id, m.segment_id, d AS first, d AS second, 1e0 AS switch FROM merged m JOIN seg USING (tumor_id, sample_id, segment_id),
    unnest(list_concat(range(1, m.a + 1), range(1, m.b + 1))) t(d) WHERE n_states = 1
  UNION ALL
  SELECT tumor_id, sample_id, segment_id, CASE k WHEN 0 THEN d1 ELSE d2 END, CASE k WHEN 0 THEN d2 ELSE d1 END, CASE WHEN d1 = d2 THEN 1e0 WHEN k = 0 THEN f1 ELSE f2 END
  FROM (SELECT two.*, unnest([{'n1': a1, 'n2': a2}, {'n1': b1, 'n2': b2}, {'n1': a1, 'n2': b2}, {'n1': b1, 'n2': a2}]) AS m FROM two) q,
    unnest(range(1, q.m.n1 + 1)) r1(d1), unnest(range(1, q.m.n2 + 1)) r2(d2), (VALUES (0), (1)) z(k)),
wsum AS (SELECT tumor_id, sample_id, segment_id, switch, first, second, SUM(exp(-3 * greatest(first * switch + second * (1 - switch) - 1, 0))) AS w
  FROM cand GROUP BY tumor_id, sample_id, segment_id, switch, first, second),
path AS (SELECT tumor_id, sample_id, segment_id, switch, CAST(first AS DOUBLE) AS first, CAST(second AS DOUBLE) AS second,
  ln(w / SUM(w) OVER (PARTITION BY tumor_id, sample_id, segment_id)) AS log_prior,
  row_number() OVER (PARTITION BY tumor_id, sample_id, segment_id ORDER BY switch, first, second) AS k FROM wsum)"""
PARTS["prof"] = """prof AS (SELECT unit.*, 5e-2 + 9e-3 * ((mutation_id * 7 + ascii(sample_id) * 3) % 100) AS phi, CAST(mutation_id % 4 AS INT) AS cluster FROM unit)"""
PARTS["up"] = """up0 AS (SELECT u.*, p.switch, p.first, p.second, p.log_prior, p.k, p.first * least(u.phi, p.switch) + p.second * greatest(u.phi - p.switch, 0) AS mass
  FROM prof u JOIN path p USING (tumor_id, sample_id, segment_id)),
up1 AS (SELECT *, least(greatest(c * mass, 1e-6), 1 - 1e-6) AS q,
  CASE WHEN c * mass > 1e-6 AND c * mass <= 1 - 1e-6 THEN c * CASE WHEN phi <= switch THEN first ELSE second END ELSE 0 END AS dq,
  CASE WHEN c * mass >= 1e-6 AND c * mass < 1 - 1e-6 THEN c * CASE WHEN phi < switch THEN first ELSE second END ELSE 0 END AS dq_right FROM up0),
up2 AS (SELECT *, alt * ln(q) + nonalt * ln(1 - q) + log_prior AS j FROM up1),
up3 AS (SELECT *, MAX(j) OVER (PARTITION BY tumor_id, mutation_id, sample_id) AS top FROM up2),
up AS (SELECT *, top + ln(SUM(exp(j - top)) OVER (PARTITION BY tumor_id, mutation_id, sample_id)) AS lse FROM up3),
upp AS (SELECT *, CASE WHEN count_observed THEN exp(j - lse) ELSE exp(log_prior) END AS post FROM up)"""
PARTS["edge"] = """vec AS (SELECT tumor_id, mutation_id, list(phi ORDER BY sample_id) AS x, list(count_observed ORDER BY sample_id) AS o FROM prof GROUP BY tumor_id, mutation_id),
msize AS (SELECT tumor_id, COUNT(*) AS m FROM vec GROUP BY tumor_id),
edge AS (SELECT a.tumor_id, a.mutation_id AS u, b.mutation_id AS v, m, len(a.x) AS s,
  list_sum(list_transform(range(1, len(a.x) + 1), lambda i: CASE WHEN a.o[i] AND b.o[i] THEN (a.x[i] - b.x[i]) * (a.x[i] - b.x[i]) ELSE 0e0 END)) AS d2,
  list_sum(list_transform(range(1, len(a.x) + 1), lambda i: CASE WHEN a.o[i] AND b.o[i] THEN 1 ELSE 0 END)) AS n_shared,
  list_transform(range(1, len(a.x) + 1), lambda i: a.x[i] - b.x[i]) AS diff
  FROM vec a JOIN vec b ON a.tumor_id = b.tumor_id AND a.mutation_id < b.mutation_id JOIN msize ON msize.tumor_id = a.tumor_id),
dist AS (SELECT tumor_id, u, v, m, CAST(n_shared AS INT) AS n_shared, CASE WHEN n_shared > 0 THEN sqrt(d2 * s / n_shared) ELSE sqrt(CAST(s AS DOUBLE)) END AS distance,
  sqrt(list_sum(list_transform(diff, lambda x: x * x))) AS nrm, diff, 1e0 / greatest(m - 1, 1) AS w FROM edge)"""
PARTS["grid"] = """beta AS (SELECT 1e-6 + CAST(i AS DOUBLE) * ((1e0 - 1e-6) / 63) AS beta FROM range(0, 64) t(i)),
em AS (SELECT p.tumor_id, p.sample_id, p.segment_id, beta, k, log_prior, p.first * least(beta, switch) + p.second * greatest(beta - switch, 0) AS mass FROM path p CROSS JOIN beta),
gj AS (SELECT u.tumor_id, u.mutation_id, u.cluster, u.sample_id, beta, alt * ln(least(greatest(c * mass, 1e-6), 1 - 1e-6)) + nonalt * ln(1 - least(greatest(c * mass, 1e-6), 1 - 1e-6)) + log_prior AS j
  FROM prof u JOIN em USING (tumor_id, sample_id, segment_id) WHERE u.count_observed),
gl AS (SELECT tumor_id, mutation_id, cluster, sample_id, beta, -(MAX(j) + ln(SUM(exp(j - m)))) AS loss FROM (
  SELECT *, MAX(j) OVER (PARTITION BY tumor_id, mutation_id, sample_id, beta) AS m FROM gj) GROUP BY tumor_id, mutation_id, cluster, sample_id, beta, m)"""
PARTS["fit"] = """cg AS (SELECT tumor_id, cluster, sample_id, beta, SUM(loss) AS loss FROM gl GROUP BY tumor_id, cluster, sample_id, beta),
fit AS (SELECT tumor_id, cluster, sample_id, beta, loss FROM cg QUALIFY row_number() OVER (PARTITION BY tumor_id, cluster, sample_id ORDER BY round(loss, 9), beta) = 1)"""
PARTS["cost"] = """cj AS (SELECT u.tumor_id, u.mutation_id, f.cluster, u.sample_id, u.count_observed, alt * ln(least(greatest(c * (p.first * least(beta, switch) + p.second * greatest(beta - switch, 0)), 1e-6), 1 - 1e-6))
    + nonalt * ln(1 - least(greatest(c * (p.first * least(beta, switch) + p.second * greatest(beta - switch, 0)), 1e-6), 1 - 1e-6)) + log_prior AS j
  FROM prof u JOIN fit f ON f.tumor_id = u.tumor_id AND f.sample_id = u.sample_id JOIN path p ON p.tumor_id = u.tumor_id AND p.sample_id = u.sample_id AND p.segment_id = u.segment_id),
cm AS (SELECT *, MAX(j) OVER (PARTITION BY tumor_id, mutation_id, cluster, sample_id) AS m FROM cj),
cu AS (SELECT tumor_id, mutation_id, cluster, sample_id, CASE WHEN bool_and(count_observed) THEN -(MAX(m) + ln(SUM(exp(j - m)))) ELSE 0e0 END AS loss FROM cm GROUP BY tumor_id, mutation_id, cluster, sample_id),
cost AS (SELECT tumor_id, mutation_id, cluster, SUM(loss) AS cost FROM cu GROUP BY tumor_id, mutation_id, cluster),
lab AS (SELECT DISTINCT tumor_id, mutation_id, cluster FROM prof),
loo AS (SELECT l.tumor_id, l.mutation_id, s.cluster, ln((s.n_k - CASE WHEN l.cluster = s.cluster THEN 1 ELSE 0 END + 1e0) / (t.n - 1 + t.k)) AS log_weight
  FROM lab l JOIN (SELECT tumor_id, cluster, COUNT(*) AS n_k FROM lab GROUP BY tumor_id, cluster) s ON s.tumor_id = l.tumor_id
  JOIN (SELECT tumor_id, COUNT(*) AS n, COUNT(DISTINCT cluster) AS k FROM lab GROUP BY tumor_id) t ON t.tumor_id = l.tumor_id)"""

UNIT_SQL, FIT_SQL = ("long", "merged", "seg", "unit"), ("long", "merged", "seg", "unit", "path", "prof")


def _sql(parts: tuple[str, ...], select: str) -> str:
    return "WITH " + ",\n".join(PARTS[p] for p in parts) + "\n" + select


def query(parts: tuple[str, ...], select: str | None):
    """Registers a query with the SQL that selects its rows from the given parts."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if select:
            ORACLE_SQL[fn.__name__] = _sql(parts, select)
        return fn

    return register


def _r(column, n: int = 6):
    """Rounded, negative zero as zero."""
    return F.round(F.col(column) if isinstance(column, str) else column, n) + 0.0


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.with_paths(cn.units(long_table(spark, sf_dir)))


def fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units with the stand-in profile phi and cluster."""
    phi = 0.05 + 0.009 * ((F.col("mutation_id") * 7 + F.ascii("sample_id") * 3) % 100)
    return units(spark, sf_dir).withColumns({"phi": phi, "cluster": (F.col("mutation_id") % 4).cast("int")})


def labels(rows: DataFrame) -> DataFrame:
    return rows.select("tumor_id", "mutation_id", "cluster").distinct()


def cohort_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels(fitted(spark, sf_dir))


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fitted(spark, sf_dir).withColumn("terms", L.log_terms())
    return rows.withColumn("post", L.posterior())


KEY = ["tumor_id", "mutation_id", "sample_id"]


# --- scan, validation -------------------------------------------------------------------------------------------------------
@query(("long",), "SELECT * FROM long")
def unit_scan(spark, sf_dir):
    return long_table(spark, sf_dir)


@query(("long",), """SELECT tumor_id, mutation_id, sample_id, cn_state_id, CAST(NULL AS VARCHAR) AS errors FROM long
  UNION ALL SELECT tumor_id, mutation_id, sample_id || ' ', cn_state_id, 'sample_id: padded' FROM long WHERE mutation_id % 10 = 3
  UNION ALL SELECT tumor_id, mutation_id, sample_id, cn_state_id, 'purity: not in (0, 1]' FROM long WHERE mutation_id % 10 = 4
  UNION ALL SELECT tumor_id, mutation_id, sample_id, cn_state_id, 'alt_count: not a whole number' FROM long WHERE mutation_id % 10 = 5
  UNION ALL SELECT tumor_id, mutation_id, sample_id, cn_state_id, 'alleles: a < b' FROM long WHERE mutation_id % 10 = 6""")  # fmt: skip
def row_normalization(spark, sf_dir):
    text = validate.as_text(long_table(spark, sf_dir))
    m = F.col("mutation_id").cast("int") % 10
    bad = [
        text.filter(m == 3).withColumn("sample_id", F.concat("sample_id", F.lit(" "))), text.filter(m == 4).withColumn("purity", F.lit("1.5")),
        text.filter(m == 5).withColumns({"alt_count": F.lit("2.5"), "ref_count": F.lit("1"), "count_observed": F.lit("1")}), text.filter(m == 6).withColumns({"allele_a_cn": F.lit("0"), "allele_b_cn": F.lit("1")}),
    ]
    for b in bad:
        text = text.union(b)
    out = validate.normalized(text)
    return out.select("tumor_id", F.col("mutation_id").cast("long").alias("mutation_id"), "sample_id", "cn_state_id", F.when(F.size("errors") > 0, F.array_join("errors", "; ")).alias("errors"))


@query(("long",), "SELECT tumor_id, sample_id, MIN(purity) AS purity, round(MAX(purity) - MIN(purity), 6) + 0.0 AS purity_spread FROM long GROUP BY tumor_id, sample_id")
def purity_canonical(spark, sf_dir):
    return cn.canonical_purity(long_table(spark, sf_dir)).withColumn("purity_spread", _r("purity_spread"))


@query(("long", "merged"), """SELECT tumor_id, sample_id, segment_id, CAST(a AS INT) AS allele_a_cn, CAST(b AS INT) AS allele_b_cn, round(fraction, 6) AS fraction,
  round(SUM(fraction) OVER (PARTITION BY tumor_id, sample_id, segment_id), 6) AS fraction_sum FROM merged""")  # fmt: skip
def state_merge(spark, sf_dir):
    return cn.merged_states(long_table(spark, sf_dir)).withColumns({"fraction": _r("fraction"), "fraction_sum": _r("fraction_sum")})


_HOLES = "SELECT * FROM long WHERE NOT (mutation_id % 7 = 2 AND sample_id = 'N') AND NOT (mutation_id % 11 = 5 AND cn_state_id = 's2')"


@query(("long",), f"""SELECT m.tumor_id, m.mutation_id, s.sample_id FROM (SELECT DISTINCT tumor_id, mutation_id FROM ({_HOLES})) m
  JOIN (SELECT DISTINCT tumor_id, sample_id FROM ({_HOLES})) s USING (tumor_id) WHERE NOT EXISTS (SELECT 1 FROM ({_HOLES}) h WHERE h.tumor_id = m.tumor_id AND h.mutation_id = m.mutation_id AND h.sample_id = s.sample_id)""")  # fmt: skip
def coverage_anti_join(spark, sf_dir):
    return validate.missing_units(_holes(spark, sf_dir))


@query(("long",), f"""SELECT tumor_id, mutation_id, sample_id FROM (SELECT tumor_id, mutation_id, sample_id, segment_id, list(DISTINCT cn_state_id ORDER BY cn_state_id) AS own FROM ({_HOLES}) GROUP BY ALL)
  JOIN (SELECT tumor_id, sample_id, segment_id, list(DISTINCT cn_state_id ORDER BY cn_state_id) AS every FROM ({_HOLES}) GROUP BY ALL) USING (tumor_id, sample_id, segment_id) WHERE own <> every""")  # fmt: skip
def state_set_check(spark, sf_dir):
    return validate.incomplete_units(_holes(spark, sf_dir))


def _holes(spark, sf_dir):
    m, s = F.col("mutation_id"), F.col("sample_id")
    return long_table(spark, sf_dir).filter(~((m % 7 == 2) & (s == "N")) & ~((m % 11 == 5) & (F.col("cn_state_id") == "s2")))


@query(("long",), "SELECT tumor_id, mutation_id, sample_id, cn_state_id, COUNT(*) AS n FROM (SELECT * FROM long UNION ALL SELECT * FROM long WHERE mutation_id % 13 = 1) GROUP BY ALL HAVING COUNT(*) > 1")
def duplicate_triples(spark, sf_dir):
    long = long_table(spark, sf_dir)
    return validate.duplicates(long.union(long.filter(F.col("mutation_id") % 13 == 1)))


@query(("long",), """SELECT tumor_id, mutation_id, sample_id FROM (SELECT tumor_id, mutation_id, sample_id, CASE WHEN mutation_id % 17 = 3 AND cn_state_id = 's2' THEN normal_cn + 1 ELSE normal_cn END AS nc FROM long)
  GROUP BY ALL HAVING MAX(nc) - MIN(nc) > 1e-10""")  # fmt: skip
def observation_agreement(spark, sf_dir):
    odd = (F.col("mutation_id") % 17 == 3) & (F.col("cn_state_id") == "s2")
    return validate.disagreeing_units(long_table(spark, sf_dir).withColumn("normal_cn", F.when(odd, F.col("normal_cn") + 1).otherwise(F.col("normal_cn"))))


# --- copy number ------------------------------------------------------------------------------------------------------------
@query(("long", "merged", "seg"), """SELECT tumor_id, sample_id, segment_id, round(mean_cn, 6) AS mean_cn, has_cna, CAST(n_states AS INT) AS n_states, CAST(major_cn AS INT) AS major_cn, CAST(minor_cn AS INT) AS minor_cn FROM seg""")
def dominant_state(spark, sf_dir):
    return cn.segments(long_table(spark, sf_dir)).select("tumor_id", "sample_id", "segment_id", _r("mean_cn").alias("mean_cn"), "has_cna", F.size("states").alias("n_states"), "major_cn", "minor_cn")


@query(UNIT_SQL, """SELECT tumor_id, mutation_id, sample_id, round(c, 6) AS scaling, n_states > 2 AS unsupported, MAX(n_states) OVER (PARTITION BY tumor_id) > 1 AS path_route,
  CASE WHEN MAX(n_states) OVER (PARTITION BY tumor_id) > 1 THEN 1e0 ELSE round(least(1, (1 - 1e-6) / greatest(c * major_cn, c * minor_cn)), 6) END AS phi_upper,
  CASE WHEN minor_cn >= 1 AND minor_cn <> major_cn THEN CAST(minor_cn AS INT) ELSE 1 END AS multiplicity_low FROM unit""")  # fmt: skip
def scaling_and_bounds(spark, sf_dir):
    return cn.units(long_table(spark, sf_dir)).select(*KEY, _r("scaling").alias("scaling"), F.col("unsupported_reason").isNotNull().alias("unsupported"), "path_route", _r("phi_upper").alias("phi_upper"), "multiplicity_low")


@query(UNIT_SQL, """SELECT tumor_id, mutation_id, sample_id, round(CASE WHEN l1 >= l2 THEN greatest(p1, 1e-6) ELSE greatest(p2, 1e-6) END, 6) AS phi_init FROM (
  SELECT *, alt * ln(least(greatest(c * major_cn * p1, 1e-6), 1 - 1e-6)) + nonalt * ln(1 - least(greatest(c * major_cn * p1, 1e-6), 1 - 1e-6)) AS l1,
    alt * ln(least(greatest(c * minor_cn * p2, 1e-6), 1 - 1e-6)) + nonalt * ln(1 - least(greatest(c * minor_cn * p2, 1e-6), 1 - 1e-6)) AS l2 FROM (
  SELECT *, least((alt + 5e-1) / (alt + nonalt + 1) / greatest(c * major_cn, 1e-6), 1) AS p1, least((alt + 5e-1) / (alt + nonalt + 1) / greatest(c * minor_cn, 1e-6), 1) AS p2 FROM unit))""")  # fmt: skip
def phi_init(spark, sf_dir):
    return cn.units(long_table(spark, sf_dir)).select(*KEY, _r(cn.phi_init()).alias("phi_init"))


# --- paths and likelihood ---------------------------------------------------------------------------------------------------
@query(("long", "merged", "seg", "unit", "path"), "SELECT tumor_id, sample_id, segment_id, CAST(k AS INT) AS k, round(switch, 6) AS switch, first, second, round(log_prior, 6) + 0.0 AS log_prior FROM path")
def path_compile(spark, sf_dir):
    seg = cn.segments(long_table(spark, sf_dir))
    out = seg.join(paths.compiled(seg), "states").select("tumor_id", "sample_id", "segment_id", F.posexplode("paths").alias("k", "p"))
    return out.select("tumor_id", "sample_id", "segment_id", (F.col("k") + 1).alias("k"), _r("p.switch").alias("switch"), "p.first", "p.second", _r("p.log_prior").alias("log_prior"))


@query((*FIT_SQL, "up"), "SELECT tumor_id, mutation_id, sample_id, CASE WHEN bool_and(count_observed) THEN round(-MAX(lse), 4) ELSE 0e0 END AS loss FROM up GROUP BY ALL")
def path_loss(spark, sf_dir):
    return terms(spark, sf_dir).select(*KEY, _r(L.loss(), 4).alias("loss"))


@query((*FIT_SQL, "up"), "SELECT tumor_id, mutation_id, sample_id, CAST(k AS INT) AS k, round(post, 6) + 0.0 AS post FROM upp")
def path_posterior(spark, sf_dir):
    return terms(spark, sf_dir).select(*KEY, F.posexplode("post").alias("k", "post")).select(*KEY, (F.col("k") + 1).alias("k"), _r("post").alias("post"))


@query((*FIT_SQL, "up"), """SELECT tumor_id, mutation_id, sample_id,
  CASE WHEN bool_and(count_observed) THEN round(-SUM(post * dq * (alt / q - nonalt / (1 - q))), 4) + 0.0 ELSE 0e0 END AS gradient,
  CASE WHEN bool_and(count_observed) THEN round(-SUM(post * dq_right * (alt / q - nonalt / (1 - q))), 4) + 0.0 ELSE 0e0 END AS gradient_right,
  CASE WHEN bool_and(count_observed) THEN round(greatest(SUM(post * dq * dq * (alt / (q * q) + nonalt / ((1 - q) * (1 - q)))), 1e-8), 3) ELSE 0e0 END AS curvature FROM upp GROUP BY ALL""")  # fmt: skip
def loss_gradient(spark, sf_dir):
    return terms(spark, sf_dir).select(*KEY, _r(L.gradient(), 4).alias("gradient"), _r(L.gradient(right=True), 4).alias("gradient_right"), _r(L.curvature(), 3).alias("curvature"))


@query((*FIT_SQL, "up"), "SELECT tumor_id, mutation_id, sample_id, CASE WHEN bool_and(count_observed) THEN round(SUM(exp(log_prior) * (log_prior - j)), 4) + 0.0 ELSE 0e0 END AS em_loss FROM up GROUP BY ALL")
def em_surrogate(spark, sf_dir):
    rows = terms(spark, sf_dir).withColumn("resp", F.transform("paths", lambda p: F.exp(p["log_prior"])))
    return rows.select(*KEY, _r(L.expected_loss(), 4).alias("em_loss"))


@query((*FIT_SQL, "up"), """SELECT tumor_id, mutation_id, sample_id, COUNT(DISTINCT round(x, 12)) AS n_points, round(COALESCE(SUM(DISTINCT round(x, 12)), 0), 6) AS point_sum FROM (
  SELECT tumor_id, mutation_id, sample_id, unnest([switch, CASE WHEN 1e-6 / c <= first * switch THEN 1e-6 / c / first ELSE switch + (1e-6 / c - first * switch) / second END,
    CASE WHEN (1 - 1e-6) / c <= first * switch THEN (1 - 1e-6) / c / first ELSE switch + ((1 - 1e-6) / c - first * switch) / second END]) AS x FROM up) WHERE x > 0 AND x < 1 GROUP BY ALL""")  # fmt: skip
def breakpoints(spark, sf_dir):
    rows = fitted(spark, sf_dir).withColumn("x", L.breakpoints())
    return rows.select(*KEY, F.size("x").cast("long").alias("n_points"), _r(F.aggregate("x", F.lit(0.0), lambda a, v: a + v)).alias("point_sum"))


@query((*FIT_SQL, "up"), """SELECT tumor_id, mutation_id, sample_id, CAST(arg_min(k, -round(post, 12) * 1000 + k * 1e-9) AS INT) AS map_path, round(SUM(CASE WHEN phi < switch - 1e-8 THEN post ELSE 0 END), 6) + 0.0 AS pre_switch_path_probability,
  round(SUM(CASE WHEN phi > switch + 1e-8 THEN post ELSE 0 END), 6) + 0.0 AS post_switch_path_probability, round(SUM(post * mass), 6) AS posterior_mutant_copy_mass, round(SUM(post * mass) / MAX(phi), 6) AS posterior_effective_multiplicity,
  round(SUM(CASE WHEN mass > phi + 1e-8 THEN post ELSE 0 END), 6) + 0.0 AS amplified_mutant_copy_probability, round(-SUM(CASE WHEN post > 0 THEN post * ln(post) ELSE 0 END), 6) + 0.0 AS path_entropy FROM upp GROUP BY ALL""")  # fmt: skip
def path_summary(spark, sf_dir):
    rows = terms(spark, sf_dir)
    rows = rows.withColumn("post", F.transform("post", lambda x: F.round(x, 12)))
    s = L.path_summary()
    names = ["pre_switch_path_probability", "post_switch_path_probability", "posterior_mutant_copy_mass", "posterior_effective_multiplicity", "amplified_mutant_copy_probability", "path_entropy"]
    return rows.select(*KEY, s["map_path"].alias("map_path"), *[_r(s[n]).alias(n) for n in names])


_LEGACY = """lg AS (SELECT *, CASE WHEN minor_cn >= 1 AND minor_cn <> major_cn THEN minor_cn ELSE 1 END AS low FROM prof),
lq AS (SELECT *, has_cna AND low < major_cn AS est, least(greatest(c * major_cn * phi, 1e-6), 1 - 1e-6) AS qm, least(greatest(c * low * phi, 1e-6), 1 - 1e-6) AS ql FROM lg),
lj AS (SELECT *, alt * ln(qm) + nonalt * ln(1 - qm) AS jm, alt * ln(ql) + nonalt * ln(1 - ql) AS jl FROM lq)"""
PARTS["legacy"] = _LEGACY


@query((*FIT_SQL, "legacy"), """SELECT tumor_id, mutation_id, sample_id, est AS multiplicity_estimated,
  CASE WHEN NOT count_observed THEN 0e0 WHEN est THEN round(-(greatest(jm, jl) + ln(5e-1 * exp(jm - greatest(jm, jl)) + 5e-1 * exp(jl - greatest(jm, jl)))), 4) ELSE round(-jm, 4) END AS loss,
  CASE WHEN NOT est THEN 1e0 WHEN NOT count_observed THEN 5e-1 ELSE round(1 / (1 + exp(jl - jm)), 6) END AS gamma_major FROM lj""")  # fmt: skip
def legacy_loss(spark, sf_dir):
    rows = fitted(spark, sf_dir).withColumn("paths", paths.legacy_paths())
    rows = rows.withColumn("terms", L.log_terms()).withColumn("post", L.posterior())
    return rows.select(*KEY, "multiplicity_estimated", _r(L.loss(), 4).alias("loss"), _r(F.element_at("post", -1)).alias("gamma_major"))


_AT = "least(greatest({c} * (p.first * least({x}, switch) + p.second * greatest({x} - switch, 0)), 1e-6), 1 - 1e-6)"
PARTS["curve"] = f"""st AS (SELECT *, phi - greatest(1e-6, phi - 1e-3) AS h1, least(1e0, phi + 1e-3) - phi AS h2 FROM prof),
pt AS (SELECT *, unnest([{{'w': 0, 'x': phi - h1}}, {{'w': 1, 'x': phi}}, {{'w': 2, 'x': phi + h2}}]) AS y FROM st),
pj AS (SELECT t.tumor_id, t.mutation_id, t.sample_id, t.y.w AS w, alt * ln({_AT.format(c="t.c", x="t.y.x")}) + nonalt * ln(1 - {_AT.format(c="t.c", x="t.y.x")}) + log_prior AS j FROM pt t JOIN path p USING (tumor_id, sample_id, segment_id)),
pm AS (SELECT *, MAX(j) OVER (PARTITION BY tumor_id, mutation_id, sample_id, w) AS m FROM pj),
pl AS (SELECT tumor_id, mutation_id, sample_id, w, -(MAX(m) + ln(SUM(exp(j - m)))) AS f FROM pm GROUP BY tumor_id, mutation_id, sample_id, w),
pw AS (SELECT tumor_id, mutation_id, sample_id, MAX(CASE WHEN w = 0 THEN f END) AS f0, MAX(CASE WHEN w = 1 THEN f END) AS f1, MAX(CASE WHEN w = 2 THEN f END) AS f2 FROM pl GROUP BY ALL),
curve AS (SELECT st.*, CASE WHEN count_observed THEN greatest(2 * (h1 * f2 - (h1 + h2) * f1 + h2 * f0) / (h1 * h2 * (h1 + h2)), 1e-6) ELSE 1e-6 END AS h FROM st JOIN pw USING (tumor_id, mutation_id, sample_id)),
capped AS (SELECT curve.*, least(h, cap) AS curvature FROM curve JOIN (SELECT tumor_id, quantile_cont(h, 0.995) AS cap FROM curve GROUP BY tumor_id) USING (tumor_id))"""


def curved(spark, sf_dir):
    """Units with their pilot curvature, capped at the tumor's 99.5 % quantile."""
    rows = fitted(spark, sf_dir).withColumn("h", L.pilot_curvature())
    cap = rows.groupBy("tumor_id").agg(F.percentile("h", F.lit(0.995)).alias("cap"))
    return rows.join(cap, "tumor_id").withColumn("curvature", F.least("h", "cap"))


@query((*FIT_SQL, "curve"), "SELECT tumor_id, mutation_id, sample_id, round(curvature, 2) AS curvature FROM capped")
def pilot_curvature(spark, sf_dir):
    return curved(spark, sf_dir).select(*KEY, _r("curvature", 2).alias("curvature"))


# --- graph, penalty, optimality ---------------------------------------------------------------------------------------------
@query((*FIT_SQL, "edge"), "SELECT tumor_id, u, v, round(w, 6) AS w FROM dist")
def edges_uniform(spark, sf_dir):
    return graph.uniform_edges(fitted(spark, sf_dir)).withColumn("w", _r("w"))


_SCALE = "sc AS (SELECT tumor_id, mutation_id, sqrt(2 * SUM(least(1 / curvature, (1 - 1e-6) * (1 - 1e-6)))) AS s FROM capped GROUP BY tumor_id, mutation_id),\ntau AS (SELECT tumor_id, greatest(median(s), 1e-6) AS tau FROM sc GROUP BY tumor_id)"
PARTS["tau"] = _SCALE


def _tau(spark, sf_dir):
    return graph.noise_floor(curved(spark, sf_dir).withColumn("width", F.lit(1.0 - L.EPS)))


@query((*FIT_SQL, "curve", "tau"), "SELECT tumor_id, round(tau, 6) AS tau FROM tau")
def noise_floor(spark, sf_dir):
    return _tau(spark, sf_dir).withColumn("tau", _r("tau"))


@query((*FIT_SQL, "curve", "tau", "edge"), """SELECT tumor_id, u, v, round(distance, 6) AS distance, round(raw / (m - 1) / AVG(raw) OVER (PARTITION BY tumor_id), 6) AS w FROM (
  SELECT dist.*, 1 / greatest(distance, tau) AS raw FROM dist JOIN tau USING (tumor_id))""")  # fmt: skip
def edges_adaptive(spark, sf_dir):
    out = graph.adaptive_edges(fitted(spark, sf_dir), _tau(spark, sf_dir), n_regions=len(REGIONS))
    return out.withColumns({"distance": _r("distance"), "w": _r("w")})


def _diffs(spark, sf_dir):
    return graph.uniform_differences(fitted(spark, sf_dir))


@query((*FIT_SQL, "edge"), "SELECT tumor_id, u, v, CAST(i - 1 AS INT) AS region, round(diff[i], 6) + 0.0 AS diff FROM dist, unnest(range(1, len(diff) + 1)) t(i)")
def edge_diff(spark, sf_dir):
    return _diffs(spark, sf_dir).select("tumor_id", "u", "v", F.posexplode("diff").alias("region", "diff")).withColumn("diff", _r("diff"))


_DUAL = "CASE WHEN nrm > 1e-6 THEN w / nrm ELSE 0e0 END"


def _dual(spark, sf_dir):
    return kkt.projected_dual(_diffs(spark, sf_dir), 1.0)


@query((*FIT_SQL, "edge"), f"SELECT tumor_id, u, v, CAST(i - 1 AS INT) AS region, round(diff[i] * {_DUAL}, 6) + 0.0 AS dual FROM dist, unnest(range(1, len(diff) + 1)) t(i)")
def analytic_dual(spark, sf_dir):
    return _dual(spark, sf_dir).select("tumor_id", "u", "v", F.posexplode("dual").alias("region", "dual")).withColumn("dual", _r("dual"))


PARTS["adj"] = f"""adj AS (SELECT tumor_id, mutation_id, i, SUM(y) AS y FROM (
  SELECT tumor_id, u AS mutation_id, i, diff[i] * {_DUAL} AS y FROM dist, unnest(range(1, len(diff) + 1)) t(i)
  UNION ALL SELECT tumor_id, v, i, -diff[i] * {_DUAL} FROM dist, unnest(range(1, len(diff) + 1)) t(i)) GROUP BY ALL)"""


@query((*FIT_SQL, "edge", "adj"), "SELECT tumor_id, mutation_id, CAST(i - 1 AS INT) AS region, round(y, 6) + 0.0 AS adj FROM adj")
def edge_adjoint(spark, sf_dir):
    return graph.uniform_flow(fitted(spark, sf_dir), len(REGIONS)).select("tumor_id", "mutation_id", F.posexplode("adj").alias("region", "adj")).withColumn("adj", _r("adj"))


@query((*FIT_SQL, "edge"), "SELECT tumor_id, round(2 * SUM(w * nrm), 6) AS penalty FROM dist GROUP BY tumor_id")
def pairwise_penalty(spark, sf_dir):
    return graph.uniform_penalty(fitted(spark, sf_dir), len(REGIONS), 2.0).withColumn("penalty", _r("penalty"))


@query((*FIT_SQL, "edge"), "SELECT tumor_id, MAX(n) AS degree FROM (SELECT tumor_id, x, COUNT(*) AS n FROM (SELECT tumor_id, unnest([u, v]) AS x FROM dist) GROUP BY ALL) GROUP BY tumor_id")
def degree_bound(spark, sf_dir):
    return graph.complete_degree(fitted(spark, sf_dir))


@query((*FIT_SQL, "edge"), "SELECT tumor_id, COUNT(*) FILTER (nrm <= 2e-1) AS fused, COUNT(*) FILTER (nrm > 2e-1) AS apart FROM dist GROUP BY tumor_id")
def edge_activity(spark, sf_dir):
    return graph.uniform_activity(fitted(spark, sf_dir), len(REGIONS), 0.2)


@query((*FIT_SQL, "edge"), "SELECT tumor_id, u, v, CAST(i - 1 AS INT) AS region, round(diff[i] / greatest(1, nrm / w), 6) + 0.0 AS dual FROM dist, unnest(range(1, len(diff) + 1)) t(i)")
def dual_ball_projection(spark, sf_dir):
    rows = _diffs(spark, sf_dir).select("tumor_id", "u", "v", F.col("diff").alias("dual"), F.col("w").alias("radius"))
    return rows.select("tumor_id", "u", "v", F.posexplode(kkt.onto_ball()).alias("region", "dual")).withColumn("dual", _r("dual"))


PARTS["res"] = """res AS (SELECT tumor_id, MAX(abs(v) / greatest(1, abs(g) + abs(y))) AS stationarity, MAX(greatest(1e-6 - phi, phi - 1, 0)) / 2 AS box_residual FROM (
  SELECT tumor_id, g, y, phi, CASE WHEN phi = 1e-6 THEN least(g + y, 0) WHEN phi = 1 THEN greatest(g + y, 0) ELSE g + y END AS v FROM (
    SELECT tumor_id, mutation_id, sample_id, MAX(phi) AS phi, row_number() OVER (PARTITION BY tumor_id, mutation_id ORDER BY sample_id) AS i,
      CASE WHEN bool_and(count_observed) THEN -SUM(post * dq * (alt / q - nonalt / (1 - q))) ELSE 0e0 END AS g FROM upp GROUP BY tumor_id, mutation_id, sample_id) JOIN adj USING (tumor_id, mutation_id, i)) GROUP BY tumor_id),
er AS (SELECT tumor_id, MAX(CASE WHEN pn >= w THEN CASE WHEN nrm > 1e-6 THEN 0e0 ELSE w * nrm / greatest(pn, 1e-300) END ELSE nrm END / greatest(1, w)) AS edge_residual
  FROM (SELECT *, CASE WHEN nrm > 1e-6 THEN nrm + w ELSE nrm END AS pn FROM dist) GROUP BY tumor_id)"""


@query((*FIT_SQL, "up", "edge", "adj", "res"), """SELECT tumor_id, round(stationarity, 6) + 0.0 AS stationarity, round(edge_residual, 6) + 0.0 AS edge_residual, 0e0 AS ball_residual, round(box_residual, 6) + 0.0 AS box_residual,
  round(greatest(stationarity, edge_residual, box_residual), 6) + 0.0 AS kkt FROM res JOIN er USING (tumor_id)""")  # fmt: skip
def kkt_residual(spark, sf_dir):
    rows = terms(spark, sf_dir).withColumn("gradient", L.gradient())
    units_ = rows.select(*KEY, "phi", "gradient", F.lit(L.EPS).alias("lower"), F.col("phi_upper").alias("upper"))
    profile = fitted(spark, sf_dir)
    out = kkt.audit_of(units_, graph.uniform_flow(profile, len(REGIONS)), kkt.uniform_maxima(profile, len(REGIONS)))
    return out.select("tumor_id", *[_r(c).alias(c) for c in ("stationarity", "edge_residual", "ball_residual", "box_residual", "kkt")])


# --- refits and assignment --------------------------------------------------------------------------------------------------
@query((*FIT_SQL, "grid", "fit"), "SELECT tumor_id, cluster, sample_id, round(beta, 6) AS beta, round(loss, 4) AS loss FROM fit")
def grid_refit(spark, sf_dir):
    rows = fitted(spark, sf_dir)
    return refit.best_centers(refit.loss_grid(rows.drop("cluster"), labels(rows))).withColumns({"beta": _r("beta"), "loss": _r("loss", 4)})


@query((*FIT_SQL, "grid"), """SELECT tumor_id, sample_id, round(beta, 6) AS beta, round(loss, 4) AS loss FROM (SELECT tumor_id, sample_id, beta, SUM(loss) AS loss FROM gl GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY tumor_id, sample_id ORDER BY round(loss, 9), beta) = 1""")  # fmt: skip
def pooled_start(spark, sf_dir):
    return refit.best_centers(refit.loss_grid(units(spark, sf_dir))).select("tumor_id", "sample_id", _r("beta").alias("beta"), _r("loss", 4).alias("loss"))


_BIC = """SELECT tumor_id, round(ll, 3) AS loglik, n_eff, CAST(n_regions AS BIGINT) AS df, round(-2 * ll + n_regions * ln(CAST(n_eff AS DOUBLE)), 3) AS bic FROM (
  SELECT tumor_id, -SUM(loss) AS ll FROM (SELECT tumor_id, sample_id, MIN(loss) AS loss FROM (SELECT tumor_id, sample_id, beta, SUM(loss) AS loss FROM gl GROUP BY ALL) GROUP BY ALL) GROUP BY tumor_id)
  JOIN (SELECT tumor_id, greatest(COUNT(*) FILTER (count_observed AND alt + nonalt > 0), 1) AS n_eff, COUNT(DISTINCT sample_id) AS n_regions FROM unit GROUP BY tumor_id) USING (tumor_id)"""


@query((*FIT_SQL, "grid"), _BIC)
def grid_refit_bic(spark, sf_dir):
    rows = units(spark, sf_dir)
    fits = refit.best_centers(refit.loss_grid(rows)).groupBy("tumor_id").agg((-F.sum("loss")).alias("loglik"), F.lit(1).cast("long").alias("k"))
    return scores.bic(scores.effective_counts(rows), fits).select("tumor_id", _r("loglik", 3).alias("loglik"), "n_eff", "df", _r("bic", 3).alias("bic"))


_WELL = """w1 AS (SELECT tumor_id, sample_id, beta, round(SUM(loss), 9) AS r FROM gl GROUP BY tumor_id, sample_id, beta),
w2 AS (SELECT *, CASE WHEN abs(r - lag(r) OVER (PARTITION BY tumor_id, sample_id ORDER BY beta)) <= 1e-9 THEN 0 ELSE 1 END AS new FROM w1),
w3 AS (SELECT *, SUM(new) OVER (PARTITION BY tumor_id, sample_id ORDER BY beta) AS block FROM w2),
w4 AS (SELECT tumor_id, sample_id, block, MIN(beta) AS beta, MIN(r) AS r FROM w3 GROUP BY ALL),
w5 AS (SELECT *, lag(r) OVER (PARTITION BY tumor_id, sample_id ORDER BY block) AS l, lead(r) OVER (PARTITION BY tumor_id, sample_id ORDER BY block) AS n FROM w4),
w6 AS (SELECT *, row_number() OVER (PARTITION BY tumor_id, sample_id ORDER BY r, beta) AS k FROM w5 WHERE (l IS NULL OR l > r) AND (n IS NULL OR n > r))"""
PARTS["well"] = _WELL


@query((*FIT_SQL, "grid", "well"), "SELECT tumor_id, sample_id, round(MAX(CASE WHEN k = 1 THEN beta END), 6) AS first_beta, round(MAX(CASE WHEN k = 2 THEN beta END), 6) AS second_beta FROM w6 WHERE k <= 2 GROUP BY ALL")
def well_pairs(spark, sf_dir):
    return refit.wells(refit.loss_grid(units(spark, sf_dir))).select("tumor_id", "sample_id", _r("first_beta").alias("first_beta"), _r("second_beta").alias("second_beta"))


def _centers(rows):
    return refit.best_centers(refit.loss_grid(rows.drop("cluster"), labels(rows)))


@query((*FIT_SQL, "grid", "fit", "cost"), "SELECT tumor_id, mutation_id, cluster, round(cost, 4) + 0.0 AS cost FROM cost")
def assignment_cost(spark, sf_dir):
    rows = fitted(spark, sf_dir)
    return refit.assignment_cost(rows.drop("cluster"), _centers(rows)).withColumn("cost", _r("cost", 4))


@query((*FIT_SQL, "grid", "fit", "cost"), "SELECT tumor_id, mutation_id, cluster, round(log_weight, 6) + 0.0 AS log_weight FROM loo")
def loo_weights(spark, sf_dir):
    return refit.leave_one_out(labels(fitted(spark, sf_dir))).withColumn("log_weight", _r("log_weight"))


@query((*FIT_SQL, "grid", "fit", "cost"), """SELECT tumor_id, mutation_id, cluster, round(t, 4) + 0.0 AS cost FROM (SELECT tumor_id, mutation_id, cluster, round(cost - 7e-1 * log_weight, 9) AS t FROM cost JOIN loo USING (tumor_id, mutation_id, cluster))
  QUALIFY row_number() OVER (PARTITION BY tumor_id, mutation_id ORDER BY t, cluster) = 1""")  # fmt: skip
def cem_step(spark, sf_dir):
    rows = fitted(spark, sf_dir)
    return refit.reassigned(rows.drop("cluster"), labels(rows), _centers(rows)).withColumn("cost", _r("cost", 4))


# --- scores, ranking, partitions --------------------------------------------------------------------------------------------
_LAB = "(SELECT DISTINCT tumor_id, mutation_id, cluster FROM prof)"


@query(FIT_SQL, f"SELECT tumor_id, cluster, COUNT(*) AS size FROM {_LAB} GROUP BY ALL")
def cluster_sizes(spark, sf_dir):
    return scores.cluster_sizes(labels(fitted(spark, sf_dir)))


PARTS["mass"] = f"""mass AS (SELECT tumor_id, COUNT(*) AS k, SUM(n_k) AS n, lgamma(COUNT(*) + 1e0) + lgamma(CAST(COUNT(*) AS DOUBLE)) + SUM(lgamma(n_k + 1e0)) - lgamma(CAST(SUM(n_k) + COUNT(*) AS DOUBLE)) AS log_mass
  FROM (SELECT tumor_id, cluster, COUNT(*) AS n_k FROM {_LAB} GROUP BY ALL) GROUP BY tumor_id)"""


@query((*FIT_SQL, "grid", "fit", "mass"), """SELECT tumor_id, round(ll, 3) AS loglik, CAST(k AS BIGINT) AS k, CAST(k * n_regions AS BIGINT) AS df, round(log_mass, 6) AS log_mass,
  round(-2 * ll + k * n_regions * ln(CAST(n_eff AS DOUBLE)) - 14e-1 * log_mass, 3) AS score FROM (SELECT tumor_id, -SUM(loss) AS ll FROM fit GROUP BY tumor_id) JOIN mass USING (tumor_id)
  JOIN (SELECT tumor_id, greatest(COUNT(*) FILTER (count_observed AND alt + nonalt > 0), 1) AS n_eff, COUNT(DISTINCT sample_id) AS n_regions FROM unit GROUP BY tumor_id) USING (tumor_id)""")  # fmt: skip
def dirichlet_score(spark, sf_dir):
    rows = fitted(spark, sf_dir)
    sizes = scores.cluster_sizes(labels(rows))
    fits = _centers(rows).groupBy("tumor_id").agg((-F.sum("loss")).alias("loglik"), F.countDistinct("cluster").alias("k"))
    out = scores.dirichlet_score(scores.effective_counts(rows), fits, sizes)
    return out.select("tumor_id", _r("loglik", 3).alias("loglik"), "k", "df", _r("log_mass").alias("log_mass"), _r("score", 3).alias("score"))


@query(FIT_SQL, f"""SELECT tumor_id, mutation_id, CAST(r - 1 AS INT) AS cluster FROM {_LAB} JOIN (SELECT tumor_id, cluster, row_number() OVER (PARTITION BY tumor_id ORDER BY MIN(mutation_id)) AS r FROM {_LAB} GROUP BY tumor_id, cluster) USING (tumor_id, cluster)""")
def canonical_labels(spark, sf_dir):
    return scores.canonical_labels(labels(fitted(spark, sf_dir)))


@query(FIT_SQL, f"""SELECT tumor_id, COUNT(*) || ':' || sha256(string_agg(block, ';' ORDER BY block)) AS signature FROM (SELECT tumor_id, cluster, sha256(string_agg(CAST(mutation_id AS VARCHAR), ',' ORDER BY mutation_id)) AS block FROM {_LAB} GROUP BY ALL) GROUP BY tumor_id""")
def partition_signature(spark, sf_dir):
    return scores.signature(labels(fitted(spark, sf_dir)))


#: Candidates for the ranking queries: one for each supplier and brand number, with repeated signatures and near ties.
_CAND_SQL = """cand0 AS (SELECT 'T' || (s_suppkey % 5) AS tumor_id, s_suppkey AS candidate_id, 'g' || (s_suppkey % 7) AS signature, CAST(s_suppkey % 6 + 1 AS BIGINT) AS k,
  CAST((s_suppkey % 6 + 1) * 3 AS BIGINT) AS df, CAST((s_suppkey * 37) % 41 AS DOUBLE) AS score, 2e0 AS uncertainty, CAST((s_suppkey * 13) % 17 AS DOUBLE) / 10 AS lam, s_suppkey % 2 = 0 AS is_raw,
  CAST((s_suppkey * 11) % 23 AS DOUBLE) AS objective, s_suppkey % 9 <> 0 AS finite_refit, CASE WHEN s_suppkey % 8 = 0 THEN 1e-2 ELSE 1e-5 END AS kkt, 1e-3 AS kkt_tolerance FROM supplier)"""
PARTS["cand"] = _CAND_SQL


def _candidates(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    x = F.col("s_suppkey")
    return s.select(
        F.concat(F.lit("T"), (x % 5).cast("string")).alias("tumor_id"), x.alias("candidate_id"), F.concat(F.lit("g"), (x % 7).cast("string")).alias("signature"), (x % 6 + 1).alias("k"), ((x % 6 + 1) * 3).alias("df"),
        ((x * 37) % 41).cast("double").alias("score"), F.lit(2.0).alias("uncertainty"), (((x * 13) % 17).cast("double") / 10).alias("lam"), (x % 2 == 0).alias("is_raw"), ((x * 11) % 23).cast("double").alias("objective"),
        (x % 9 != 0).alias("finite_refit"), F.when(x % 8 == 0, 1e-2).otherwise(1e-5).alias("kkt"), F.lit(1e-3).alias("kkt_tolerance"),
    )


@query(("cand",), "SELECT tumor_id, candidate_id, CASE WHEN NOT finite_refit THEN 'refit_not_finite' WHEN kkt > kkt_tolerance THEN 'not_stationary' END AS reason FROM cand0")
def candidate_eligibility(spark, sf_dir):
    return _candidates(spark, sf_dir).select("tumor_id", "candidate_id", scores.eligibility().alias("reason"))


@query(("cand",), "SELECT tumor_id, k, candidate_id, score FROM cand0 QUALIFY row_number() OVER (PARTITION BY tumor_id, k ORDER BY score, objective, candidate_id) <= 5")
def topk_per_k(spark, sf_dir):
    return scores.best_per(_candidates(spark, sf_dir), ["tumor_id", "k"], ["score", "objective", "candidate_id"], 5).select("tumor_id", "k", "candidate_id", "score")


@query(("cand",), "SELECT tumor_id, signature, candidate_id FROM cand0 QUALIFY row_number() OVER (PARTITION BY tumor_id, signature ORDER BY score, k, df, candidate_id) = 1")
def dedup_signature(spark, sf_dir):
    return scores.best_per(_candidates(spark, sf_dir), ["tumor_id", "signature"], ["score", "k", "df", "candidate_id"]).select("tumor_id", "signature", "candidate_id")


@query(("cand",), """SELECT tumor_id, candidate_id, signature, score FROM (SELECT *, MIN(score + uncertainty) OVER (PARTITION BY tumor_id) AS cut FROM (
    SELECT * FROM cand0 WHERE finite_refit AND kkt <= kkt_tolerance QUALIFY row_number() OVER (PARTITION BY tumor_id, signature ORDER BY score, k, df, lam, objective, candidate_id) = 1)) WHERE score - uncertainty <= cut
  QUALIFY row_number() OVER (PARTITION BY tumor_id ORDER BY k, df, lam, NOT is_raw, signature, objective, candidate_id) = 1""")  # fmt: skip
def select_candidate(spark, sf_dir):
    return scores.select_candidates(_candidates(spark, sf_dir)).select("tumor_id", "candidate_id", "signature", "score")


PARTS["pd"] = f"pd AS (SELECT dist.*, x.cluster AS cu, y.cluster AS cv FROM dist JOIN {_LAB} x ON x.tumor_id = dist.tumor_id AND x.mutation_id = u JOIN {_LAB} y ON y.tumor_id = dist.tumor_id AND y.mutation_id = v)"


@query((*FIT_SQL, "edge", "pd"), f"""SELECT tumor_id, cluster, round(COALESCE(MAX(d), 0), 6) AS diameter FROM (SELECT DISTINCT tumor_id, cluster FROM {_LAB})
  LEFT JOIN (SELECT tumor_id, cu AS cluster, nrm AS d FROM pd WHERE cu = cv) USING (tumor_id, cluster) GROUP BY ALL""")  # fmt: skip
def cluster_diameter(spark, sf_dir):
    rows = fitted(spark, sf_dir)
    return partitions.diameters(rows, labels(rows), len(REGIONS)).withColumn("diameter", _r("diameter"))


@query((*FIT_SQL, "edge", "pd"), "SELECT tumor_id, least(cu, cv) AS a, greatest(cu, cv) AS b, round(MAX(nrm), 6) AS farthest, round(MIN(nrm), 6) AS nearest FROM pd WHERE cu <> cv GROUP BY ALL")
def cross_block_distance(spark, sf_dir):
    rows = fitted(spark, sf_dir)
    return partitions.cross_distances(rows, labels(rows), len(REGIONS)).withColumns({"farthest": _r("farthest"), "nearest": _r("nearest")})


@query((*FIT_SQL, "edge"), """, near AS MATERIALIZED (SELECT tumor_id, u, v FROM dist WHERE distance <= 3e-2 UNION ALL SELECT tumor_id, v, u FROM dist WHERE distance <= 3e-2),
  reach AS (SELECT tumor_id, mutation_id AS r, mutation_id AS x FROM vec UNION SELECT reach.tumor_id, r, near.v FROM reach JOIN near ON near.tumor_id = reach.tumor_id AND near.u = reach.x)
  SELECT tumor_id, x AS mutation_id, MIN(r) AS component FROM reach GROUP BY ALL""")  # fmt: skip
def connected_components(spark, sf_dir):
    return partitions.components(fitted(spark, sf_dir), 0.03, n_regions=len(REGIONS))


ORACLE_SQL["connected_components"] = ORACLE_SQL["connected_components"].replace("WITH ", "WITH RECURSIVE ", 1).replace("\n, near", ", near", 1)


@query((), None)
def complete_link(spark, sf_dir):
    return partitions.complete_link(fitted(spark, sf_dir), 0.1)


# --- results ----------------------------------------------------------------------------------------------------------------
@query((*FIT_SQL, "grid", "fit"), f"""SELECT l.tumor_id, l.mutation_id, l.cluster + 1 AS cluster_label, round(MAX(CASE WHEN sample_id = 'A' THEN beta END), 6) AS "phi_A", round(MAX(CASE WHEN sample_id = 'N' THEN beta END), 6) AS "phi_N",
  round(MAX(CASE WHEN sample_id = 'R' THEN beta END), 6) AS "phi_R" FROM {_LAB} l JOIN fit USING (tumor_id, cluster) GROUP BY ALL""")  # fmt: skip
def mutation_clusters(spark, sf_dir):
    from tessera.plans import report

    rows = fitted(spark, sf_dir)
    out = report.mutation_clusters(labels(rows), _centers(rows), list(REGIONS))
    return out.withColumns({f"phi_{r}": _r(f"phi_{r}") for r in "ANR"})


@query((*FIT_SQL, "grid", "fit"), f"""SELECT tumor_id, cluster + 1 AS cluster_label, MAX(size) AS cluster_size, round(MAX(CASE WHEN sample_id = 'A' THEN beta END), 6) AS "phi_A", round(MAX(CASE WHEN sample_id = 'N' THEN beta END), 6) AS "phi_N",
  round(MAX(CASE WHEN sample_id = 'R' THEN beta END), 6) AS "phi_R" FROM fit JOIN (SELECT tumor_id, cluster, COUNT(*) AS size FROM {_LAB} GROUP BY ALL) USING (tumor_id, cluster) GROUP BY tumor_id, cluster""")  # fmt: skip
def cluster_centers(spark, sf_dir):
    from tessera.plans import report

    rows = fitted(spark, sf_dir)
    out = report.cluster_centers(labels(rows), _centers(rows), list(REGIONS))
    return out.withColumns({f"phi_{r}": _r(f"phi_{r}") for r in "ANR"})


@query((*FIT_SQL, "grid", "fit"), """SELECT tumor_id, mutation_id, sample_id AS region_id, cluster + 1 AS cluster_label, round(beta, 6) AS phi, CAST(major_cn AS INT) AS major_cn, CAST(minor_cn AS INT) AS minor_cn FROM prof JOIN fit USING (tumor_id, cluster, sample_id)""")
def mutation_region_multiplicity(spark, sf_dir):
    from tessera.plans import report

    rows = fitted(spark, sf_dir)
    out = report.mutation_regions(rows.drop("cluster", "phi"), labels(rows), _centers(rows))
    return out.select("tumor_id", "mutation_id", "region_id", "cluster_label", _r("phi").alias("phi"), "major_cn", "minor_cn")


# --- iterative kernels: rows only ------------------------------------------------------------------------------------------
@query((), None)
def ward_labels(spark, sf_dir):
    from tessera.operators import kernels

    return kernels.ward_labels(units(spark, sf_dir))


@query((), None)
def cem_refine(spark, sf_dir):
    from tessera.operators import kernels

    return kernels.cem_labels(units(spark, sf_dir))


@query((), None)
def interval_certificate(spark, sf_dir):
    from tessera.operators import kernels

    return kernels.certified_refit(fitted(spark, sf_dir))


@query((), None)
def admm_fit(spark, sf_dir):
    from tessera.operators import kernels

    return kernels.fused_profiles(units(spark, sf_dir), 0.5)
