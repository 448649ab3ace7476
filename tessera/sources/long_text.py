"""Long tumor tables as tab-separated text, plain or gzip: ``##key=value`` lines, one header, ``#`` comments, "." for missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.validate import COLUMNS, normalized, problems, safe_id_error

SCHEMA_ID = "tumor.long.v1"
DEFAULTS = {"genome_build": "unknown", "coordinate_system": "unknown", "missing_value": "."}


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, no, line): every line with its number. Line numbers need a file's lines together, so each file is one row first;
    a file is one tumor."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    rows = files.select("file", F.posexplode(F.split("value", "\n", -1)).alias("no", "line"))
    return rows.select("file", "no", F.regexp_replace("line", "\r$", "").alias("line"))


def default_tumor_id(file="file"):
    """The file's name without folders and the suffixes .gz, .tsv and .txt."""
    name = F.element_at(F.split(F.col(file), "/"), -1)
    return F.regexp_replace(F.regexp_replace(name, r"(?i)\.gz$", ""), r"(?i)\.(tsv|txt)$", "")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(file, tumor_id, metadata): the ``##key=value`` lines over the defaults. Raises for lines without a key, repeated keys,
    metadata after the header, another missing value than ".", and ids that can't be file names."""
    lines = _lines(spark, path)
    meta = lines.filter(F.col("line").startswith("##"))
    key = F.trim(F.regexp_extract("line", r"^##([^=]+)=(.*)$", 1))
    pairs = meta.select("file", "no", key.alias("key"), F.trim(F.regexp_extract("line", r"^##([^=]+)=(.*)$", 2)).alias("value"))
    header = lines.filter("trim(line) <> '' AND NOT startswith(line, '#')").groupBy("file").agg(F.min("no").alias("header"))
    once = pairs.groupBy("file", "key").agg(F.min_by("value", "no").alias("value"), F.max("no").alias("no"), F.count("*").alias("n"))
    found = once.join(header, "file", "left").groupBy("file").agg(
        F.bool_or(F.col("key") == "").alias("broken"), F.bool_or(F.col("n") > 1).alias("repeated"), F.bool_or(F.col("no") > F.col("header")).alias("late"), F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("own")
    )
    defaults = F.create_map(*[F.lit(x) for kv in DEFAULTS.items() for x in kv])
    own = F.coalesce("own", F.create_map().cast("map<string,string>"))
    out = header.select("file").join(found, "file", "left").select("file", "broken", "repeated", "late", F.map_concat(F.map_filter(defaults, lambda k, v: ~F.map_contains_key(own, k)), own).alias("metadata"))
    out = out.withColumn("tumor_id", F.coalesce(F.col("metadata")["tumor_id"], default_tumor_id()))
    problem = (
        F.when(F.col("broken"), "metadata line without key").when(F.col("repeated"), "repeated metadata key").when(F.col("late"), "metadata after the header")
        .when(F.col("metadata")["missing_value"] != ".", "missing_value must be .").when(~F.coalesce(F.col("metadata")["schema"], F.lit(SCHEMA_ID)).endswith(SCHEMA_ID), "unknown schema").otherwise(safe_id_error("tumor_id"))
    )
    bad = out.select("file", problem.alias("problem")).filter("problem IS NOT NULL").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0].file}: {bad[0].problem}")
    return out.select("file", "tumor_id", "metadata")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(tumor_id, the twelve columns as strings). Other columns are dropped as they are read. Raises for missing or repeated
    columns, rows of another width than their header, and empty cells."""
    lines = _lines(spark, path).filter("trim(line) <> '' AND NOT startswith(line, '#')")
    first = lines.groupBy("file").agg(F.min_by("line", "no").alias("header"), F.min("no").alias("at"))
    names = F.split("header", "\t", -1)
    bad = first.select("file", F.array_except(F.lit(COLUMNS), names).alias("missing"), (F.size(names) > F.size(F.array_distinct(names))).alias("twice")).filter("size(missing) > 0 OR twice").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0].file}: " + ("repeated column" if bad[0].twice else f"missing columns {bad[0].missing}"))
    rows = lines.join(first, "file").filter("no > at").withColumn("cells", F.split("line", "\t", -1))
    wrong = F.when(F.col("line") == F.col("header"), "second header").when(F.size("cells") != F.size(names), "wrong number of cells").when(F.exists("cells", lambda c: c == ""), "empty cell")
    bad = rows.select("file", "no", wrong.alias("problem")).filter("problem IS NOT NULL").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0].file}, line {bad[0].no + 1}: {bad[0].problem}")
    ids = read_metadata(spark, path).select("file", "tumor_id")
    cells = [F.element_at("cells", F.array_position(names, c).cast("int")).alias(c) for c in COLUMNS]
    return rows.join(ids, "file").select("tumor_id", *cells)


def load(spark: SparkSession, path: str) -> DataFrame:
    """A validated long table of all tumors below ``path``. Raises ValueError with the first problem of its rows or groups."""
    typed = normalized(read_text(spark, path))
    bad = typed.filter("size(errors) > 0").select("tumor_id", "errors").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0].tumor_id}: {bad[0].errors[0]}")
    long = typed.drop("errors")
    found = problems(long).orderBy("tumor_id", "problem").limit(1).collect()
    if found:
        raise ValueError(f"{found[0].tumor_id}: {found[0].problem} ({found[0].n})")
    return long


def number_text(column):
    """Numbers as their shortest exact text, whole ones without a point; null as "."."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.when(c.cast("double") == F.floor(c.cast("double")), c.cast("decimal(38,0)").cast("string")).otherwise(c.cast("string")), F.lit("."))


def write(long: DataFrame, path: str, metadata: dict[str, str] | None = None) -> None:
    """One file for each tumor below ``path``/tumor_id=…: sorted metadata, header, rows in the order of mutation, region and
    state; extra columns follow the twelve. A file is one tumor, so its lines are sorted in one task, which may spill; no row
    holds more than a line."""
    extra = [c for c in long.columns if c not in COLUMNS and c != "tumor_id"]
    numbers = {"alt_count", "ref_count", "purity", "normal_cn", "cn_state_fraction", "allele_a_cn", "allele_b_cn"}
    cells = [number_text(c) if c in numbers else F.when(F.col(c), "1").otherwise("0") if c == "count_observed" else F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in COLUMNS + extra]
    order = [F.col("mutation_id").cast("string").alias("m"), F.col("sample_id").cast("string").alias("s"), F.col("cn_state_id").cast("string").alias("c")]
    rows = long.select("tumor_id", F.lit(2).alias("part"), *order, F.concat_ws("\t", *cells).alias("value"))
    fixed = {"schema": SCHEMA_ID, **DEFAULTS, **(metadata or {})}
    head = F.array(*[F.lit(f"##{k}={v}") for k, v in fixed.items() if k != "tumor_id"], F.concat(F.lit("##tumor_id="), F.col("tumor_id")))
    none = [F.lit("").alias("s"), F.lit("").alias("c")]
    tumors = long.select("tumor_id").distinct()
    before = tumors.select("tumor_id", F.explode(head).alias("value")).select("tumor_id", F.lit(0).alias("part"), F.col("value").alias("m"), *none, "value")
    names = tumors.select("tumor_id", F.lit(1).alias("part"), F.lit("").alias("m"), *none, F.lit("\t".join(COLUMNS + extra)).alias("value"))
    lines = rows.union(before).union(names).repartition("tumor_id").sortWithinPartitions("tumor_id", "part", "m", "s", "c")
    lines.select("tumor_id", "value").write.partitionBy("tumor_id").mode("overwrite").text(path)
