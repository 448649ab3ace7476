"""Boilerplate lines by site-relative frequency, with DataFrame functions only.

For every host, the pages that contain a line are divided by the host's pages; lines over a ratio go. That is all, unless asked
for more: a least number of pages; pages of equal texts counted once, so that a page that was crawled many times doesn't turn
its own lines into boilerplate; pages that would lose every line left as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import whole_text, written

#: A host's rules are broadcast below this many bytes (measured); above, the join shuffles.
BROADCAST_BYTES = 8 << 20
#: Share of a host's pages over which a line is boilerplate. On sf0.1 (some 500 pages a host) the one site line is on 8.7 % to
#: 13.2 % of the pages of every host, repeated sentences of the prose on 4.7 % at most; on small hosts ``min_pages`` decides,
#: without which every line of a host with fewer than 1 / RATIO pages is over it.
RATIO = 0.06


def _digest(column):
    """128 bits of a string."""
    return F.struct(F.xxhash64(column).alias("a"), F.xxhash64(F.lit(7), column).alias("b"))


def _lines(column):
    return F.split(column, "\n", -1)


def _key(line):
    return F.btrim(line, F.lit(" \t\r"))


def _host(host: str | Column) -> Column:
    return F.coalesce((F.col(f"`{host}`") if isinstance(host, str) else host).cast("string"), F.lit(""))


def url_host(url: str = "url") -> Column:
    """The lower-case host of a URL, as ``host`` of pages that come with one; null if it has none."""
    return F.lower(F.try_parse_url(F.col(url), F.lit("HOST")))


def boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = 1, host: str | Column = "source", distinct_pages: bool = False) -> DataFrame:
    """(host, lines): digests of the host's boilerplate lines, for hosts that have some.

    A line is boilerplate if more than ``ratio`` of its host's pages, and at least ``min_pages`` of them, contain it, compared
    without surrounding blanks; blank lines never are. ``distinct_pages`` counts pages of a host with equal texts once, on
    both sides. At most (mean lines a page) / ratio lines of a host can be boilerplate.
    """
    text = whole_text("`text`")
    page = _digest(text) if distinct_pages else None
    seen = pages.select(_host(host).alias("host"), *([page.alias("page")] if distinct_pages else []), text.alias("text"))
    keys = F.array_distinct(F.filter(F.transform(_lines(F.col("text")), _key), lambda x: x != ""))
    own = seen.select("host", *(["page"] if distinct_pages else []), F.transform(keys, _digest).alias("lines"))
    if distinct_pages:
        totals = seen.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("total"))
        rows = own.select("host", "page", F.explode("lines").alias("line")).distinct()
    else:
        totals, rows = seen.groupBy("host").agg(F.count("*").alias("total")), own.select("host", F.explode("lines").alias("line"))
    counts = rows.groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    over = counts.join(totals, "host").filter(F.col("n") > F.lit(float(ratio)) * F.col("total"))
    return over.groupBy("host").agg(F.collect_list("line").alias("lines"))


def drop_boilerplate(
    pages: DataFrame, ratio: float = RATIO, min_pages: int = 1, host: str | Column = "source", distinct_pages: bool = False, keep_emptied: bool = False, counts: bool = False
) -> DataFrame:
    """``pages`` with the boilerplate lines of each page's host removed from ``text``; other columns as they are.

    Every row stays, repeated rows included. A page that has none to lose keeps its text (null and empty texts too), and with
    ``keep_emptied`` so does one that would lose all but blank lines; a null host is the host with the empty name. A very
    long text is handled whole, in memory by its length. ``counts`` adds n_lines and n_dropped (long; lines that are not
    blank). Whatever other columns are called, they don't interfere; an empty table gives no rows. Hosts without rules cost a
    lookup in a broadcast table as long as the rules, measured first, fit; else the join shuffles and skewed hosts are split.
    """
    rules = written(boilerplate(pages, ratio, min_pages, host, distinct_pages), "line-rules")
    size = rules.agg(F.sum(F.octet_length("host") + 32 + 32 * F.size("lines"))).first()[0] or 0
    rules = rules.select(F.col("host").alias("rule_host"), "lines")
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), _host(host).alias("host"))
    joined = rows.join(F.broadcast(rules) if size <= BROADCAST_BYTES else rules, F.col("host") == F.col("rule_host"), "left")
    text = F.col("row.text")
    full = F.size(F.filter(_lines(text), lambda x: _key(x) != ""))
    kept = F.filter(_lines(text), lambda x: ~F.array_contains(F.col("lines"), _digest(_key(x))))
    joined = joined.withColumn("kept", F.when(F.col("lines").isNotNull(), kept))
    left = F.size(F.filter(F.col("kept"), lambda x: _key(x) != ""))
    cut = F.col("kept").isNotNull() & (left < full)
    if keep_emptied:
        cut = cut & (left > 0)
    new = F.when(cut, F.array_join("kept", "\n")).otherwise(text)
    out = [new.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in pages.columns]
    if counts:
        out += [F.coalesce(full, F.lit(0)).cast("long").alias("n_lines"), F.when(cut, full - left).otherwise(0).cast("long").alias("n_dropped")]
    return joined.select(*out)


#: The same rows in DuckDB, for ratio 0.1 and 3 pages.
SQL = r"""
WITH p AS (SELECT doc_id, source, text, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
total AS (SELECT host, count(*) AS total FROM p GROUP BY host),
l AS (SELECT host, unnest(list_distinct(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x, chr(32) || chr(9) || chr(13))), lambda x: x <> ''))) AS line FROM p),
r AS (SELECT n.host, list(n.line) AS lines FROM (SELECT host, line, count(*) AS n FROM l GROUP BY host, line) n
      JOIN total USING (host) WHERE n.n >= 3 AND n.n > 1e-1 * total.total GROUP BY n.host),
k AS (SELECT p.*, string_split(t, chr(10)) AS every,
        CASE WHEN r.lines IS NULL THEN string_split(t, chr(10))
             ELSE list_filter(string_split(t, chr(10)), lambda x: NOT list_contains(r.lines, trim(x, chr(32) || chr(9) || chr(13)))) END AS kept
      FROM p LEFT JOIN r ON r.host = p.host),
s AS (SELECT *, len(list_filter(every, lambda x: trim(x, chr(32) || chr(9) || chr(13)) <> '')) AS n_all,
        len(list_filter(kept, lambda x: trim(x, chr(32) || chr(9) || chr(13)) <> '')) AS n_kept FROM k)
SELECT doc_id, source, CASE WHEN n_kept < n_all THEN array_to_string(kept, chr(10)) ELSE text END AS text,
       n_all AS n_lines, n_all - n_kept AS n_dropped FROM s
"""
