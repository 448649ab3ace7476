"""Audit of how far the sources of a language differ in their use of words.

Two passes over the texts. The first takes exact document frequencies of all terms, combined inside tasks before they are
shuffled, and keeps those in enough documents of their language. The second recounts occurrences of the kept terms with an
Aho-Corasick automaton, in which every term has a delimiter on both sides: a text is reduced to its terms and single delimiters,
so each match is one whole term. The automaton holds a bounded part of the vocabulary; a larger vocabulary takes several runs.

Counts are sparse postings (language, term, source). Pairs of sources are compared inside blocks of terms: where both sources
lack a term its share is a constant of the source, so only postings are touched, and a block gives one row a pair of sources.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import whole_text, written

#: Documents of its language that a kept term must be in; what is added to each count; ranks of terms that are reported.
MIN_DOCS, PRIOR, TOP_TERMS = 30, 5, 50
#: Terms and UTF-8 bytes that one automaton holds at most (a single longer term makes one of its own).
PART_TERMS, PART_BYTES = 250_000, 4 << 20
#: Different counters that a task keeps before it hands them on.
HELD = 400_000
#: Terms of a block and sources of a side in the comparison of pairs.
BLOCK_TERMS, BLOCK_SOURCES = 2048, 64

_SCALE = 1_000_000_000
#: Bytes to terms: A to Z in small letters, every other ASCII character but small letters a space; all others stay.
_TERMS = bytes(ord(chr(c).lower()) if chr(c) in string.ascii_letters else c if c > 127 else 32 for c in range(256))


def reduced(text: str) -> bytes:
    """The text's terms in UTF-8, with one or more spaces between them."""
    return text.encode("utf-8", "surrogatepass").translate(_TERMS)


def _batch(groups: list[tuple], items: list[pa.Array], counts: list[Counter], names: list[str]) -> pa.RecordBatch:
    """Rows of each group's names, the items counted in it and their counts."""
    columns = [[pa.repeat(pa.scalar(g[k], pa.string()), len(c)) for g, c in zip(groups, counts, strict=True)] for k in range(len(groups[0]))]
    columns += [items, [pa.array(np.fromiter(c.values(), np.int64, len(c))) for c in counts]]
    return pa.record_batch([pa.concat_arrays(c) for c in columns], names=names)


def _document_terms(most: int):
    """(lang, term, n): n documents of this task have the term. At most about ``most`` counters are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        size = 0

        def out() -> pa.RecordBatch:
            counts = list(held.items())
            held.clear()
            return _batch([(g,) for g, _ in counts], [pa.array(list(c), pa.string()) for _, c in counts], [c for _, c in counts], ["lang", "term", "n"])

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = held.setdefault(lang, Counter())
                size -= len(own)
                own.update(set(reduced(text).split()))
                size += len(own)
                if size > most:
                    yield out()
                    size = 0
        if held:
            yield out()

    return run


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, docs): terms in at least ``min_docs`` documents of (lang, text)."""
    return docs.select("lang", "text").mapInArrow(_document_terms(HELD), "lang string, term string, n long").groupBy("lang", "term").agg(F.sum("n").alias("docs")).filter(F.col("docs") >= min_docs)


def _parts(kept: DataFrame, part_terms: int, part_bytes: int) -> tuple[DataFrame, int]:
    """The different terms with a number of their part; no part of more than one term passes both bounds."""
    terms = written(kept.groupBy("term").agg(F.count("*").alias("langs")).select("term", F.xxhash64("term").alias("h")), "terms")
    n, size = terms.agg(F.count("*"), F.sum(F.octet_length("term"))).first()
    parts = max(1, -(-n // part_terms), -(-(size or 0) // part_bytes))
    while True:
        dealt = terms.select("term", F.pmod("h", F.lit(parts)).cast("int").alias("part"))
        full = dealt.groupBy("part").agg(F.count("*").alias("n"), F.sum(F.octet_length("term")).alias("size")).filter((F.col("n") > 1) & ((F.col("n") > part_terms) | (F.col("size") > part_bytes)))
        if full.isEmpty():
            return dealt, parts
        parts *= 2


def _recount(shared, most: int):
    """(lang, source, id, n) of the terms of one part, which is built into an automaton once a task; id is a term's place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        found = ahocorasick.Automaton()
        for i, t in enumerate(terms):
            found.add_word(f" {t} ", i)
        found.make_automaton()
        held: dict[tuple[str, str], Counter] = {}
        size = 0

        def out() -> pa.RecordBatch:
            counts = list(held.items())
            held.clear()
            return _batch([g for g, _ in counts], [pa.array(np.fromiter(c, np.int32, len(c))) for _, c in counts], [c for _, c in counts], ["lang", "source", "id", "n"])

        for b in batches:
            for lang, source, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                padded = f" {b' '.join(reduced(text).split()).decode('utf-8', 'surrogatepass')} "
                own = held.setdefault((lang, source), Counter())
                size -= len(own)
                own.update(map(itemgetter(1), found.iter(padded)))
                size += len(own)
                if size > most:
                    yield out()
                    size = 0
        if held:
            yield out()

    return run


def _named(shared):
    """(lang, source, term, n) for rows with numbers of terms of one part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = pa.array(shared.value, pa.string())
        for b in batches:
            yield pa.record_batch([b.column(0), b.column(1), terms.take(b.column(2)), b.column(3)], names=["lang", "source", "term", "n"])

    return run


def postings(docs: DataFrame, kept: DataFrame, part_terms: int = PART_TERMS, part_bytes: int = PART_BYTES) -> DataFrame:
    """(lang, source, term, n): occurrences, at least one, of the kept terms of the language in each of its sources."""
    dealt, parts = _parts(kept, part_terms, part_bytes)
    runs = None
    for part in range(parts):
        terms = [r.term for r in dealt.filter(F.col("part") == part).select("term").sort("term").collect()]  # at most part_terms
        if terms:
            shared = docs.sparkSession.sparkContext.broadcast(terms)
            run = docs.select("lang", "source", "text").mapInArrow(_recount(shared, HELD), "lang string, source string, id int, n long")
            run = run.groupBy("lang", "source", "id").agg(F.sum("n").alias("n")).mapInArrow(_named(shared), "lang string, source string, term string, n long")
            runs = run if runs is None else runs.union(run)
    if runs is None:
        return docs.sparkSession.createDataFrame([], "lang string, source string, term string, n long")
    return runs.join(kept.select("lang", "term"), ["lang", "term"]).select("lang", "source", "term", "n")


def _share(n, total, terms):
    """1 + floor(10^9 (n + 5) / (total + 5 V)), in whole numbers throughout."""
    whole = (n.cast("decimal(20,0)") + PRIOR) * F.lit(_SCALE).cast("decimal(10,0)")
    whole = whole.cast("decimal(38,0)")
    base = (total.cast("decimal(20,0)") + PRIOR * terms.cast("decimal(18,0)")).cast("decimal(38,0)")
    return ((whole - F.pmod(whole, base)) / base).cast("long") + 1


def _distances(left: pd.DataFrame) -> pd.DataFrame:
    """Distances of all pairs of one side's sources with the other's, summed over one block of terms.

    Rows with ``term`` -1 are the sources (p: the share of a term it lacks), with the block's number of terms in ``n``.
    """
    where = left["term"].to_numpy() < 0
    heads, rows = left[where].sort_values("source"), left[~where]
    n = int(heads["n"].iloc[0])
    term, code = np.unique(rows["term"].to_numpy(), return_inverse=True)
    out = []
    tables = {}
    for side in (0, 1):
        own = heads[heads["side"] == side]
        names = own["source"].to_numpy()
        base = own["p"].to_numpy()
        table = np.repeat(base[:, None], len(term), axis=1)
        mine = rows["side"].to_numpy() == side
        table[np.searchsorted(names, rows["source"].to_numpy()[mine]), code[mine]] = rows["p"].to_numpy()[mine]
        tables[side] = names, base, table
    (names, base, table), (other_names, other_base, other) = tables[0], tables[1]
    for name, b, row in zip(names.tolist(), base.tolist(), table, strict=True):
        total = np.abs(other - row).sum(axis=1) + (n - len(term)) * np.abs(other_base - b)
        out.append(pd.DataFrame({"lang_id": left["lang_id"].iloc[0], "a": name, "b": other_names, "value": total}))
    return pd.concat(out, ignore_index=True)


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, part_terms: int = PART_TERMS, part_bytes: int = PART_BYTES) -> DataFrame:
    """(lang, source, part, item, value, rank) of ``docs`` with columns text, lang and source.

    Part ``pair`` ranks the other sources of the language by the sum of |p - q| over its kept terms, largest first; part
    ``term`` ranks, up to ``top_terms``, the kept terms that a source uses more than its language does. Ties go by the item's
    UTF-8 bytes. Null texts, languages and sources count as empty ones; a source without kept terms still has its pairs; a
    language without kept terms gives pairs of value 0; a language of one source no pairs. Repeated rows are documents of their
    own; very long texts are counted whole; an empty table gives no rows; other columns, whatever their names, are not read.
    """
    rows = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], whole_text("`text`").alias("text"))
    kept = written(kept_terms(rows, min_docs), "kept-terms")
    found = written(postings(rows, kept, part_terms, part_bytes), "postings")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    groups = rows.groupBy("lang", "source").agg(F.count("*").alias("docs")).join(found.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"), F.xxhash64("lang").alias("lang_id"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1
    groups = written(groups.withColumn("number", number), "groups")
    number = F.row_number().over(Window.partitionBy("lang", "block").orderBy("term")).cast("long") - 1
    blocks = F.ceil(F.col("terms") / BLOCK_TERMS).cast("long")
    numbered = kept.join(sizes, "lang").select("lang", "term", F.pmod(F.xxhash64("term"), blocks).alias("block"))
    numbered = written(numbered.withColumn("number", number), "numbered-terms")
    shares = found.join(groups, ["lang", "source"]).select("lang", "source", "term", F.col("number").alias("source_number"), _share(F.col("n"), F.col("total"), F.col("terms")).alias("p"))
    shares = written(shares, "shares")

    whole = found.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    totals = found.groupBy("lang").agg(F.sum("n").alias("total")).join(sizes, "lang")
    whole = whole.join(totals, "lang").select("lang", "term", _share(F.col("n"), F.col("total"), F.col("terms")).alias("q"))
    high = shares.join(whole, ["lang", "term"]).filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    high = high.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_terms)

    # every source goes to the blocks of terms of its language, once for each block of sources that it is compared with
    many = groups.groupBy("lang").agg((F.max("number") / BLOCK_SOURCES).cast("long").alias("last"))
    heads = groups.select("lang", "lang_id", F.col("number").alias("source"), _share(F.lit(0), F.col("total"), F.greatest("terms", F.lit(1))).alias("p"))
    used = numbered.groupBy("lang", "block").agg(F.count("*").alias("n"))
    heads = heads.join(used, "lang").select("lang", "lang_id", "block", "source", F.lit(-1).cast("long").alias("term"), "p", "n")
    body = shares.join(numbered.withColumnRenamed("number", "term_number"), ["lang", "term"]).select("lang", F.xxhash64("lang").alias("lang_id"), "block", F.col("source_number").alias("source"), F.col("term_number").alias("term"), "p", F.lit(0).cast("long").alias("n"))
    mine = (F.col("source") / BLOCK_SOURCES).cast("long")
    dealt = heads.union(body).join(many, "lang").withColumn("mine", mine)
    left = dealt.select("lang_id", "block", F.col("mine").alias("i"), F.explode(F.sequence("mine", "last")).alias("j"), F.lit(0).alias("side"), "source", "term", "p", "n")
    right = dealt.select("lang_id", "block", F.explode(F.sequence(F.lit(0).cast("long"), "mine")).alias("i"), F.col("mine").alias("j"), F.lit(1).alias("side"), "source", "term", "p", "n")
    sums = left.union(right).groupBy("lang_id", "block", "i", "j").applyInPandas(_distances, "lang_id long, a long, b long, value long")
    sums = sums.filter("a < b").groupBy("lang_id", "a", "b").agg(F.sum("value").alias("value"))
    sums = written(sums, "distances")
    names = groups.select("lang", "lang_id", "number", "source")
    both = sums.union(sums.select("lang_id", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    pairs = both.join(names.withColumnRenamed("number", "a"), ["lang_id", "a"]).join(names.select("lang_id", F.col("number").alias("b"), F.col("source").alias("item")), ["lang_id", "b"]).select("lang", "source", "item", "value")
    bare = groups.filter("terms = 0").select("lang", "source")
    bare = bare.join(bare.withColumnRenamed("source", "item"), "lang").filter("source <> item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    pairs = pairs.union(bare).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    return pairs.union(high).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))


#: DuckDB's twin: all counts by lists of matches, all pairs of sources over the whole vocabulary of their language.
SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
words AS (SELECT k, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT k) >= 30),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
counts AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept USING (lang, term) GROUP BY w.lang, w.source, w.term),
groups AS (
  SELECT g.lang, g.source, coalesce(t.total, 0) AS total, coalesce(s.v, 0) AS v
  FROM (SELECT DISTINCT lang, source FROM docs) g
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source) t USING (lang, source)
  LEFT JOIN sizes s USING (lang)),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)::HUGEINT) // (g.total + 5 * g.v) AS p
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
langs AS (SELECT lang, sum(n) AS total FROM counts GROUP BY lang),
whole AS (
  SELECT c.lang, c.term, 1 + (1000000000 * (sum(c.n) + 5)::HUGEINT) // (any_value(l.total) + 5 * any_value(s.v)) AS q
  FROM counts c JOIN langs l USING (lang) JOIN sizes s USING (lang) GROUP BY c.lang, c.term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
high AS (SELECT s.lang, s.source, s.term AS item, s.p - w.q AS value FROM shares s JOIN whole w USING (lang, term) WHERE s.n > 0 AND s.p > w.q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS rank FROM high)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
