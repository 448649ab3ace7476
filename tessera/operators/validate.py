"""Validation of long tables: row normalization of text cells, and group checks that return the offending keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ["mutation_id", "sample_id", "alt_count", "ref_count", "count_observed", "purity", "normal_cn", "segment_id", "cn_state_id", "cn_state_fraction", "allele_a_cn", "allele_b_cn"]
IDENTIFIERS = ["mutation_id", "sample_id", "segment_id", "cn_state_id"]
TOLERANCE, WHOLE_TOLERANCE, SUM_TOLERANCE = 1e-10, 1e-8, 1e-8


def as_text(long: DataFrame) -> DataFrame:
    """The table as a text file holds it: every cell a string, "." for missing, 1 and 0 for booleans."""
    cells = [F.coalesce(F.when(F.col(c), "1").otherwise("0") if c == "count_observed" else F.col(c).cast("string"), F.lit(".")).alias(c) for c in COLUMNS]
    return long.select(*[c for c in long.columns if c not in COLUMNS], *cells)


def identifier_error(c: str):
    """What is wrong with an identifier, null if nothing."""
    x = F.col(c)
    return (
        F.when(x.isNull() | (x == ""), f"{c}: empty")
        .when(x != F.btrim(x, F.lit(" \t\r\n")), f"{c}: padded")
        .when(x == ".", f"{c}: missing")
        .when(x.startswith("#"), f"{c}: starts with #")
        .when(x.rlike(r"[\t\r\n]"), f"{c}: tab or line break")
    )


def safe_id_error(c: str):
    """As ``identifier_error``, and no path separators or parent folders."""
    x = F.col(c)
    return F.coalesce(identifier_error(c), F.when(x.rlike(r"[/\\]") | x.isin(".", ".."), f"{c}: not a file name"))


def finite(c: str):
    """The cell as a finite double, else null."""
    x = F.expr(f"try_cast({c} AS double)")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def whole(c: str):
    """The cell as a non-negative whole number within the tolerance ("12.0" is one), else null."""
    x = finite(c)
    return F.when((x >= 0) & (F.abs(x - F.round(x)) <= WHOLE_TOLERANCE), F.round(x).cast("long"))


def same(a, b):
    return F.abs(a - b) <= TOLERANCE


def normalized(text: DataFrame) -> DataFrame:
    """Typed columns and ``errors``, the list of what is wrong with a row (empty if nothing). Rows are kept, so callers can
    report all errors at once or filter; other columns stay."""
    observed = F.col("count_observed")
    errors = [identifier_error(c) for c in IDENTIFIERS]
    errors.append(F.when(~observed.isin("0", "1") | observed.isNull(), "count_observed: not 0 or 1"))
    for c in ("alt_count", "ref_count"):
        errors.append(F.when((F.col(c) == ".") & (observed == "1"), f"{c}: missing").when((F.col(c) != ".") & whole(c).isNull(), f"{c}: not a whole number"))
    purity, normal, fraction, a, b = finite("purity"), finite("normal_cn"), finite("cn_state_fraction"), whole("allele_a_cn"), whole("allele_b_cn")
    errors += [
        F.when(purity.isNull() | (purity <= 0) | (purity > 1), "purity: not in (0, 1]"), F.when(normal.isNull() | (normal < 0), "normal_cn: negative or no number"),
        F.when(fraction.isNull() | (fraction <= 0), "cn_state_fraction: not positive"), F.when(a.isNull() | b.isNull(), "alleles: not whole numbers").when(a < b, "alleles: a < b"),
    ]
    typed = {"alt_count": whole("alt_count"), "ref_count": whole("ref_count"), "count_observed": observed == "1", "purity": purity, "normal_cn": normal, "cn_state_fraction": fraction, "allele_a_cn": a.cast("int"), "allele_b_cn": b.cast("int")}
    return text.withColumn("errors", F.filter(F.array(*errors), lambda e: e.isNotNull())).withColumns(typed)


def duplicates(long: DataFrame) -> DataFrame:
    """(tumor_id, mutation_id, sample_id, cn_state_id, n) of states that a unit names more than once."""
    return long.groupBy("tumor_id", "mutation_id", "sample_id", "cn_state_id").agg(F.count("*").alias("n")).filter("n > 1")


def missing_units(long: DataFrame) -> DataFrame:
    """(tumor_id, mutation_id, sample_id) of a tumor's mutations and regions that have no row. Regions are gathered as a set
    for each tumor, so the product is an explode within the tumor."""
    regions = long.groupBy("tumor_id").agg(F.collect_set("sample_id").alias("every"))
    seen = long.groupBy("tumor_id", "mutation_id").agg(F.collect_set("sample_id").alias("own"))
    return seen.join(regions, "tumor_id").select("tumor_id", "mutation_id", F.explode(F.array_except("every", "own")).alias("sample_id"))


def incomplete_units(long: DataFrame) -> DataFrame:
    """(tumor_id, mutation_id, sample_id) of units whose states aren't all those of their segment."""
    key = ["tumor_id", "sample_id", "segment_id"]
    every = long.groupBy(*key).agg(F.array_sort(F.collect_set("cn_state_id")).alias("every"))
    own = long.groupBy(*key, "mutation_id").agg(F.array_sort(F.collect_set("cn_state_id")).alias("own"))
    return own.join(every, key).filter("own <> every").select("tumor_id", "mutation_id", "sample_id")


def disagreeing_units(long: DataFrame) -> DataFrame:
    """(tumor_id, mutation_id, sample_id) of units whose rows don't name the same counts, segment, purity and normal copies."""
    exact = [F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("."))) > 1 for c in ("alt_count", "ref_count", "count_observed", "segment_id")]
    near = [F.max(c) - F.min(c) > TOLERANCE for c in ("purity", "normal_cn")]
    bad = exact[0]
    for e in (*exact[1:], *near):
        bad = bad | e
    return long.groupBy("tumor_id", "mutation_id", "sample_id").agg(bad.alias("bad")).filter("bad").select("tumor_id", "mutation_id", "sample_id")


def inconsistent_states(long: DataFrame) -> DataFrame:
    """(tumor_id, sample_id, segment_id, problem): states defined in two ways, or fractions that don't add up to one."""
    key = ["tumor_id", "sample_id", "segment_id"]
    states = long.groupBy(*key, "cn_state_id").agg(
        (F.count_distinct("allele_a_cn", "allele_b_cn") > 1).alias("alleles"), (F.max("cn_state_fraction") - F.min("cn_state_fraction") > TOLERANCE).alias("fractions"), F.min("cn_state_fraction").alias("f")
    )
    seg = states.groupBy(*key).agg(F.bool_or("alleles").alias("alleles"), F.bool_or("fractions").alias("fractions"), (F.abs(F.sum("f") - 1) > SUM_TOLERANCE).alias("sums"))
    problem = F.when(F.col("alleles"), "state with two allele pairs").when(F.col("fractions"), "state with two fractions").when(F.col("sums"), "fractions do not sum to 1")
    return seg.withColumn("problem", problem).filter("problem IS NOT NULL").select(*key, "problem")


def problems(long: DataFrame) -> DataFrame:
    """(tumor_id, problem, n): all group checks of a long table, with how often each fails; empty for a valid table."""
    purity = long.groupBy("tumor_id", "sample_id").agg((F.max("purity") - F.min("purity") > TOLERANCE).alias("bad")).filter("bad")
    found = [
        duplicates(long).select("tumor_id", F.lit("repeated state of a unit").alias("problem")), purity.select("tumor_id", F.lit("purity varies in a sample").alias("problem")),
        inconsistent_states(long).select("tumor_id", "problem"), missing_units(long).select("tumor_id", F.lit("missing unit").alias("problem")),
        incomplete_units(long).select("tumor_id", F.lit("incomplete states of a unit").alias("problem")), disagreeing_units(long).select("tumor_id", F.lit("disagreeing rows of a unit").alias("problem")),
    ]
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return every.groupBy("tumor_id", "problem").agg(F.count("*").alias("n"))
