"""Clone trees as tables: lineages, fractions, copy-number profiles, local states, timing of mutations and gains, invariants.

``tree`` is (tumor_id, clone_id, parent_id), the root's parent -1; ``cells`` is (tumor_id, clone_id, sample_id, ccf), a clone with
all its descendants; ``copies`` is (tumor_id, clone_id, segment_id, allele_a_cn, allele_b_cn). A cohort's trees are handled
together; only tumors are keys, so they spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CLONE = ["tumor_id", "clone_id"]


def descendants(tree: DataFrame) -> DataFrame:
    """(tumor_id, clone_id, below): every clone with itself and all that descend from it."""
    return tree.sparkSession.sql(
        """WITH RECURSIVE line(tumor_id, clone_id, below) AS (
             SELECT tumor_id, clone_id, clone_id FROM {tree}
             UNION ALL SELECT l.tumor_id, t.parent_id, l.below FROM line l JOIN {tree} t ON t.tumor_id = l.tumor_id AND t.clone_id = l.clone_id WHERE t.parent_id >= 0)
           SELECT tumor_id, clone_id, below FROM line""",
        tree=tree,
    )


def exclusive_fractions(tree: DataFrame, cells: DataFrame) -> DataFrame:
    """(tumor_id, clone_id, sample_id, fraction): a clone's cells less those of its children."""
    children = cells.join(tree.filter("parent_id >= 0"), CLONE).groupBy("tumor_id", F.col("parent_id").alias("clone_id"), "sample_id").agg(F.sum("ccf").alias("children"))
    return cells.join(children, [*CLONE, "sample_id"], "left").select(*CLONE, "sample_id", (F.col("ccf") - F.coalesce("children", F.lit(0.0))).alias("fraction"))


def profile_ids(copies: DataFrame) -> DataFrame:
    """(tumor_id, clone_id, cn_clone_id): clones of equal copy numbers in all segments share an id; ids count by first clone."""
    profile = copies.groupBy(*CLONE).agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("segment_id", "allele_a_cn", "allele_b_cn")))), 256).alias("profile"))
    first = profile.groupBy("tumor_id", "profile").agg(F.min("clone_id").alias("first"))
    ids = first.withColumn("cn_clone_id", (F.row_number().over(Window.partitionBy("tumor_id").orderBy("first")) - 1).cast("int"))
    return profile.join(ids, ["tumor_id", "profile"]).select(*CLONE, "cn_clone_id")


def profile_fractions(exclusive: DataFrame, ids: DataFrame) -> DataFrame:
    """(tumor_id, cn_clone_id, sample_id, fraction): cells of each copy-number profile."""
    return exclusive.join(ids, CLONE).groupBy("tumor_id", "cn_clone_id", "sample_id").agg(F.sum("fraction").alias("fraction"))


def genome(spark: SparkSession, segments: int, size: int = 1_000_000, chromosome: int = 1) -> DataFrame:
    """(segment_id, chromosome, start, end): segments of equal size, end to end, positions from 1."""
    return spark.range(segments).select(F.col("id").cast("int").alias("segment_id"), F.lit(chromosome).alias("chromosome"), (F.col("id") * size + 1).alias("start"), ((F.col("id") + 1) * size).alias("end"))


def profile_table(copies: DataFrame, ids: DataFrame, segments: DataFrame) -> DataFrame:
    """One row for each clone and segment: its profile's id, place, copies of both alleles, major, minor and total."""
    a, b = F.col("allele_a_cn"), F.col("allele_b_cn")
    rows = copies.join(ids, CLONE).join(F.broadcast(segments), "segment_id")  # a genome's segments are few
    return rows.select(*CLONE, "cn_clone_id", "segment_id", "chromosome", "start", "end", a, b, F.greatest(a, b).alias("major_cn"), F.least(a, b).alias("minor_cn"), (a + b).alias("total_cn"))


def local_states(copies: DataFrame, exclusive: DataFrame, phased: bool = True, least: float = 0.0) -> DataFrame:
    """(tumor_id, sample_id, segment_id, allele_a_cn, allele_b_cn, fraction, clones): the states of a segment in a region with the
    cells that have them and their clones; unphased states have the larger number first. Fractions up to ``least`` go."""
    a, b = F.col("allele_a_cn"), F.col("allele_b_cn")
    rows = copies if phased else copies.withColumns({"allele_a_cn": F.greatest(a, b), "allele_b_cn": F.least(a, b)})
    out = rows.join(exclusive, CLONE).groupBy("tumor_id", "sample_id", "segment_id", "allele_a_cn", "allele_b_cn").agg(F.sum("fraction").alias("fraction"), F.array_sort(F.collect_set("clone_id")).alias("clones"))
    return out.filter(F.col("fraction") > least)


def mutation_truth(dosage: DataFrame, exclusive: DataFrame, copies: DataFrame, purity: float, normal_cn: float = 2.0) -> DataFrame:
    """(tumor_id, mutation_id, sample_id, ccf, mutant_copy_mass, mean_total_cn, effective_multiplicity, expected_vaf) from the
    copies of a mutation in each clone, (tumor_id, mutation_id, segment_id, clone_id, dosage)."""
    rows = dosage.join(copies, [*CLONE, "segment_id"]).join(exclusive, CLONE)
    f, d = F.col("fraction"), F.col("dosage")
    out = rows.groupBy("tumor_id", "mutation_id", "sample_id").agg(F.sum(F.when(d > 0, f).otherwise(0.0)).alias("ccf"), F.sum(d * f).alias("mutant_copy_mass"), F.sum((F.col("allele_a_cn") + F.col("allele_b_cn")) * f).alias("mean_total_cn"))
    share = purity * F.col("mutant_copy_mass") / (purity * F.col("mean_total_cn") + (1 - purity) * normal_cn)
    return out.withColumns({"effective_multiplicity": F.when(F.col("ccf") > 0, F.col("mutant_copy_mass") / F.col("ccf")), "expected_vaf": share})


def timing(mutations: DataFrame, events: DataFrame, lineage: DataFrame) -> DataFrame:
    """(tumor_id, mutation_id, event_id, precedes): mutations and the gains of their segment on one line of descent; a mutation
    precedes gains below its clone, and on its own branch those that come later.

    ``mutations`` are (tumor_id, mutation_id, clone_id, segment_id, branch_time), ``events`` (tumor_id, event_id, clone_id,
    segment_id, branch_time), ``lineage`` as from ``descendants``.
    """
    e = events.select("tumor_id", "event_id", "segment_id", F.col("clone_id").alias("event_clone"), F.col("branch_time").alias("event_time")).distinct()
    both = mutations.join(e, ["tumor_id", "segment_id"])
    line = lineage.filter("clone_id <> below")
    under = line.select("tumor_id", "clone_id", F.col("below").alias("event_clone"), F.lit(True).alias("event_under"))
    over = line.select("tumor_id", F.col("clone_id").alias("event_clone"), F.col("below").alias("clone_id"), F.lit(True).alias("event_over"))
    both = both.join(under, ["tumor_id", "clone_id", "event_clone"], "left").join(over, ["tumor_id", "clone_id", "event_clone"], "left")
    same = F.col("clone_id") == F.col("event_clone")
    precedes = F.when(same, F.col("branch_time") < F.col("event_time")).when(F.col("event_under"), True).when(F.col("event_over"), False)
    return both.select("tumor_id", "mutation_id", "event_id", precedes.alias("precedes")).filter("precedes IS NOT NULL")


def timing_summary(pairs: DataFrame, mutations: DataFrame) -> DataFrame:
    """(tumor_id, n_pairs, before_share, after_share, mutations_before, mutations_after): shares of comparable pairs, and of all
    mutations that precede or follow some gain; zeros where there are none."""
    n = mutations.groupBy("tumor_id").agg(F.countDistinct("mutation_id").alias("n"))
    by = pairs.groupBy("tumor_id").agg(F.count("*").alias("n_pairs"), F.count_if("precedes").alias("b"), F.countDistinct(F.when(F.col("precedes"), F.col("mutation_id"))).alias("mb"), F.countDistinct(F.when(~F.col("precedes"), F.col("mutation_id"))).alias("ma"))
    out = n.join(by, "tumor_id", "left").na.fill(0, ["n_pairs", "b", "mb", "ma"])
    pairs_ = F.greatest("n_pairs", F.lit(1))
    return out.select("tumor_id", "n_pairs", (F.col("b") / pairs_).alias("before_share"), ((F.col("n_pairs") - F.col("b")) / pairs_).alias("after_share"), (F.col("mb") / F.col("n")).alias("mutations_before"), (F.col("ma") / F.col("n")).alias("mutations_after"))


def state_counts(copies: DataFrame) -> DataFrame:
    """(tumor_id, segment_id, n_states, altered): different unphased states of a segment over all clones."""
    a, b = F.col("allele_a_cn"), F.col("allele_b_cn")
    return copies.groupBy("tumor_id", "segment_id").agg(F.countDistinct(F.struct(F.greatest(a, b), F.least(a, b))).alias("n_states"), F.bool_or((a != 1) | (b != 1)).alias("altered"))


def histogram(rows: DataFrame, value: str, top: int = 4) -> DataFrame:
    """(tumor_id, bucket, n, share): counts by value, from ``top`` on together as <top>_plus."""
    bucket = F.when(F.col(value) >= top, f"{top}_plus").otherwise(F.col(value).cast("string"))
    out = rows.groupBy("tumor_id", bucket.alias("bucket")).agg(F.count("*").alias("n"))
    total = rows.groupBy("tumor_id").agg(F.count("*").alias("total"))
    return out.join(total, "tumor_id").select("tumor_id", "bucket", "n", (F.col("n") / F.col("total")).alias("share"))


def spread(rows: DataFrame, value: str) -> DataFrame:
    """(tumor_id, minimum, mean, maximum)."""
    return rows.groupBy("tumor_id").agg(F.min(value).alias("minimum"), F.avg(value).alias("mean"), F.max(value).alias("maximum"))


def profile_entropy(fractions: DataFrame) -> DataFrame:
    """(tumor_id, sample_id, entropy) of the copy-number profiles' fractions."""
    f = F.col("fraction")
    return fractions.groupBy("tumor_id", "sample_id").agg((-F.sum(F.when(f > 0, f * F.ln(f)).otherwise(0.0))).alias("entropy"))


def complexity(copies: DataFrame, ids: DataFrame, mutations: DataFrame, events: DataFrame, truth: DataFrame, dosage: DataFrame) -> DataFrame:
    """One row a tumor: how complex its copy numbers and multiplicities turned out."""
    seg = state_counts(copies)
    per_seg = seg.groupBy("tumor_id").agg(F.avg(F.col("altered").cast("double")).alias("altered_segment_fraction"), F.max("n_states").alias("maximum_local_state_count"))
    alleles = copies.groupBy("tumor_id").agg(F.max(F.greatest("allele_a_cn", "allele_b_cn")).alias("maximum_allele_cn"))
    clones = ids.groupBy("tumor_id").agg(F.countDistinct("cn_clone_id").alias("whole_genome_cn_clone_count"))
    event = events.groupBy("tumor_id").agg(F.countDistinct("event_id").alias("applied_cna_event_count"))
    on = mutations.join(seg, ["tumor_id", "segment_id"]).groupBy("tumor_id").agg(F.avg(F.col("altered").cast("double")).alias("fraction_mutations_on_altered_segments"))
    top = dosage.groupBy("tumor_id", "mutation_id").agg(F.max("dosage").alias("d"))
    top = top.groupBy("tumor_id").agg(F.max("d").alias("maximum_clone_specific_dosage"), F.avg((F.col("d") > 1).cast("double")).alias("fraction_mutations_with_dosage_gt_one"))
    m = F.col("effective_multiplicity")
    odd = truth.filter(m.isNotNull()).groupBy("tumor_id").agg(F.avg((F.abs(m - F.round(m)) > 1e-8).cast("double")).alias("fraction_noninteger_effective_multiplicity"))
    out = per_seg
    for other in (alleles, clones, event, on, top, odd):
        out = out.join(other, "tumor_id", "left")
    return out.na.fill(0)


def violations(tree: DataFrame, cells: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """(tumor_id, sample_id, clone_id, rule): where a tree or its fractions can't be: a parent that doesn't exist, a root that
    isn't 1, a fraction outside [0, 1], above its parent's, or below the sum of its children's or of its leaves'."""
    parents = tree.select("tumor_id", F.col("clone_id").alias("parent_id")).withColumn("known", F.lit(True))
    lost = tree.filter("parent_id >= 0").join(parents, ["tumor_id", "parent_id"], "left").filter("known IS NULL").select("tumor_id", F.lit(None).cast("string").alias("sample_id"), "clone_id", F.lit("no such parent").alias("rule"))
    rows = cells.join(tree, CLONE)
    above = cells.select("tumor_id", F.col("clone_id").alias("parent_id"), "sample_id", F.col("ccf").alias("parent_ccf"))
    rows = rows.join(above, ["tumor_id", "parent_id", "sample_id"], "left").join(exclusive_fractions(tree, cells), [*CLONE, "sample_id"])
    leaves = tree.join(tree.select("tumor_id", F.col("parent_id").alias("clone_id")).distinct(), CLONE, "left_anti").select("tumor_id", F.col("clone_id").alias("below"))
    under = descendants(tree).join(leaves, ["tumor_id", "below"]).join(cells.withColumnsRenamed({"clone_id": "below", "ccf": "leaf"}), ["tumor_id", "below"])
    rows = rows.join(under.groupBy(*CLONE, "sample_id").agg(F.sum("leaf").alias("leaves")), [*CLONE, "sample_id"], "left")
    c = F.col("ccf")
    rules = {
        "root is not 1": (F.col("parent_id") < 0) & (F.abs(c - 1) > tolerance), "outside [0, 1]": (c < -tolerance) | (c > 1 + tolerance), "above its parent": c > F.col("parent_ccf") + tolerance,
        "below its children": F.col("fraction") < -tolerance, "below its leaves": F.col("leaves") > c + tolerance,
    }
    broken = F.filter(F.array(*[F.when(cond, rule) for rule, cond in rules.items()]), lambda r: r.isNotNull())
    return rows.select("tumor_id", "sample_id", "clone_id", F.explode(broken).alias("rule")).union(lost)
