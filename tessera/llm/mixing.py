"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

The documents of a source are laid end to end in an order fixed by a digest of their ids and texts and cut into blocks of equal
bytes. With weights a that add up to P, block j (from 0) of a source is released at floor(j P / a) and due at
ceil((j + 1) P / a); in each slot the released block with the earliest deadline runs (ties: by source). As the shares a / P
add up to one, every block runs within its window, so after t slots each source has run less than one block more or less
than its target a t / P. Weights are exact whole numbers; nothing is rounded. After a source's last block the others stay in their
windows, and a slot is empty if no block is released.

The driver plans with a heap: it sees one row a source and keeps 8 bytes for each planned block. At a multiple of P every
released block has run, so a period's schedule depends only on the number of blocks that each source has in it: periods of
equal numbers are planned once, in at most two ways for each source that ends. The plan goes back as arrays of ``CHUNK``
slots. All rows are placed by joins and windows.
"""

from __future__ import annotations

import heapq
import math
from array import array
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import whole_text, written

#: Bytes of a block.
BLOCK_BYTES = 32768
#: Steps of the default weights: this many times the square root of a source's blocks. The period is then at most SCALE times
#: the root of (sources times blocks): 4 million slots for 20 sources and 100 TB.
SCALE = 16
#: Slots of a source in one row of the plan, and the slots up to which the plan is broadcast.
CHUNK, BROADCAST_SLOTS = 4096, 1 << 23
#: Blocks up to which the plan isn't made by periods.
PLAIN_SLOTS = 1 << 22
#: Rows that one window of the running sum holds, about.
WINDOW_ROWS = 4096


def earliest_deadline_first(shares: list[tuple[int, int]], p: int) -> list[array]:
    """Slots of all blocks of each source, from (weight, number of blocks) in the order that breaks ties; the weights of these
    and of sources without blocks sum up to ``p``."""
    out = [array("q") for _ in shares]
    waiting = [(0, i) for i, (_, n) in enumerate(shares) if n > 0]  # release and source of its next block; sorted, so a heap
    ready: list[tuple[int, int]] = []  # deadline and source
    push, pop, t = heapq.heappush, heapq.heappop, 0
    while waiting or ready:
        if not ready:
            t = max(t, waiting[0][0])
        while waiting and waiting[0][0] <= t:
            i = pop(waiting)[1]
            push(ready, (-(-(len(out[i]) + 1) * p // shares[i][0]), i))
        i = pop(ready)[1]
        out[i].append(t)
        if len(out[i]) < shares[i][1]:
            push(waiting, (len(out[i]) * p // shares[i][0], i))
        t += 1
    return out


def phases(shares: list[tuple[int, int]], p: int, plain_slots: int = PLAIN_SLOTS) -> Iterator[tuple[int, int, dict[int, array]]]:
    """(first cycle, cycles or 0 for no division into any, slots by source): what is planned. Up to ``plain_slots`` blocks are planned
    as they come; more by periods, of which those with equal numbers of blocks are planned once. Both give equal slots."""
    if sum(n for _, n in shares) <= plain_slots:
        yield 0, 0, dict(enumerate(earliest_deadline_first(shares, p)))
        return
    left, cycle = {i: n for i, (_, n) in enumerate(shares) if n}, 0
    while left:
        own = [(i, shares[i][0], min(shares[i][0], n)) for i, n in left.items()]
        times = min(max(1, left[i] // a) for i, a, _ in own)
        ats = earliest_deadline_first([(a, m) for _, a, m in own], p)
        yield cycle, times, {i: x for (i, _, _), x in zip(own, ats, strict=True)}
        left = {i: rest for i, _, m in own if (rest := left[i] - m * times)}
        cycle += times


def _plan(spark: SparkSession, shares: list[tuple[str, int, int]], p: int, plain_slots: int) -> tuple[DataFrame, DataFrame]:
    """(ss, sc, sp, ats): slots, within a cycle, of a source's blocks from sp * CHUNK on, in the cycles from sc on; and
    (qs, a, p, cycles): a source's weight, the period, and the first cycles of its phases (none if there are no cycles)."""
    shares = sorted(shares, key=lambda x: x[0].encode())
    starts: dict[str, list[int]] = {name: [] for name, _, _ in shares}

    def rows() -> Iterator[tuple[str, int, int, list[int]]]:
        for cycle, times, ats_of in phases([x[1:] for x in shares], p, plain_slots):
            for i, ats in ats_of.items():
                if times:
                    starts[shares[i][0]].append(cycle)
                for part in range(-(-len(ats) // CHUNK)):
                    yield shares[i][0], cycle, part, ats[part * CHUNK : (part + 1) * CHUNK].tolist()

    plan = written(spark.createDataFrame(list(rows()), "ss string, sc long, sp long, ats array<long>"), "mixing-plan")
    return plan, spark.createDataFrame([(name, a, p, starts[name]) for name, a, _ in shares], "qs string, a long, p long, cycles array<long>")


def _scheduled(docs: DataFrame, block_bytes: int, weights: dict[str, int] | None, source: str, carried: list[Column], plain_slots: int = PLAIN_SLOTS) -> DataFrame:
    """row (struct of the ``carried`` columns), source, md (order in the source), block, release, deadline, slot. Only what is
    carried is shuffled with a document, not its text."""
    name = F.coalesce(F.col(f"`{source}`").cast("string"), F.lit(""))
    text = whole_text("`text`")
    rows = docs.select(
        F.struct(*carried).alias("row"), name.alias("source"), F.octet_length(text).cast("long").alias("bytes"),
        F.md5(F.concat_ws(":", F.coalesce(F.col("`doc_id`").cast("string"), F.lit("")), F.md5(text.cast("binary"))).cast("binary")).alias("md"),
    )
    sizes = written(rows.groupBy("source").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")), "source-sizes").collect()  # one row a source
    if weights is None:
        given = {r.source: math.isqrt(SCALE * SCALE * r.bytes // int(block_bytes)) for r in sizes}
    else:
        given = {r.source: int(weights.get(r.source, 0)) for r in sizes}
    least = max(0, reduce(math.gcd, [max(1, w) for w in given.values()], 0)) or 1
    # one row a source; the last document may start where the last block ends
    shares = [(r.source, max(1, given[r.source]) // least, r.bytes // int(block_bytes) + 1) for r in sizes]
    period = sum(a for _, a, _ in shares)
    plan, quota = _plan(docs.sparkSession, shares, period, plain_slots)
    if sum(n for _, _, n in shares) <= min(plain_slots, BROADCAST_SLOTS):
        plan = F.broadcast(plan)
    if len(shares) <= BROADCAST_SLOTS >> 6:
        quota = F.broadcast(quota)
    n_rows = sum(r.n for r in sizes)
    digits = max(0, math.ceil(math.log(max(1, n_rows / WINDOW_ROWS), 16)))  # hex digits of md that tell the windows of a source apart
    rows = rows.withColumn("bucket", F.substring("md", 1, digits))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("source", "bucket").agg(F.sum("bytes").alias("sum")).select("source", "bucket", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("source", "bucket").orderBy("md").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("run", F.coalesce(F.sum("bytes").over(within), F.lit(0))).join(offsets, ["source", "bucket"])
    rows = rows.withColumn("block", F.expr(f"(offset + run) div {int(block_bytes)}L"))
    rows = rows.join(quota, F.col("source") == F.col("qs"))
    cyclic = F.size("cycles") > 0
    rows = rows.withColumn("cycle", F.when(cyclic, F.expr("block div a")).otherwise(0)).withColumn("i", F.when(cyclic, F.col("block") % F.col("a")).otherwise(F.col("block")))
    rows = rows.withColumn("phase", F.coalesce(F.expr("array_max(filter(cycles, x -> x <= cycle))"), F.lit(0)))
    here = (F.col("source") == F.col("ss")) & (F.col("phase") == F.col("sc")) & (F.expr(f"i div {CHUNK}") == F.col("sp"))
    rows = rows.join(plan, here).withColumn("at", F.col("ats")[(F.col("i") % CHUNK).cast("int")])
    return rows.select(
        "row", "source", "md", "block", F.expr("(block * p) div a").alias("release"), F.expr("((block + 1) * p + a - 1) div a").alias("deadline"),
        F.expr("cycle * p + at").alias("slot"),
    )


def slots(docs: DataFrame, block_bytes: int = BLOCK_BYTES, weights: dict[str, int] | None = None, source: str = "source") -> DataFrame:
    """(doc_id, source, block, release, deadline, slot) for every row of ``docs``; none is dropped or repeated.

    A document's block is the one that it starts in; a very long one reaches over many blocks and stays whole. ``weights``
    are whole target weights by source (missing or 0: weight 1); by default ``SCALE`` times the square root of a source's
    blocks, which lies between its share and equal shares. A null source has the empty name, null texts no bytes; rows with
    equal ids come in the order of their texts' digests, and equal rows, each of which stays, side by side. An empty table
    gives no rows; other columns, whatever their names, are not read.
    """
    return _scheduled(docs, block_bytes, weights, source, [F.col("`doc_id`").alias("doc_id")]).select(F.col("row.doc_id").alias("doc_id"), "source", "block", "release", "deadline", "slot")


def mixed(docs: DataFrame, block_bytes: int = BLOCK_BYTES, weights: dict[str, int] | None = None, source: str = "source") -> DataFrame:
    """All rows of ``docs``, their columns unchanged, dealt by range and sorted in the order of ``slots``."""
    rows = _scheduled(docs, block_bytes, weights, source, [F.col(f"`{c}`") for c in docs.columns])
    order = ["slot", "md"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*[F.col("row")[c].alias(c) for c in docs.columns])


def placed(docs: DataFrame, block_bytes: int = BLOCK_BYTES, weights: dict[str, int] | None = None, source: str = "source") -> DataFrame:
    """(doc_id, text_sha256, source, block, slot, position) for every row of ``docs``: the order of ``mixed`` as columns.

    position counts from 0 within a slot, which is one block; (slot, position) is unique.
    """
    carried = [F.col("`doc_id`").cast("long").alias("doc_id"), F.sha2(whole_text("`text`").cast("binary"), 256).alias("text_sha256")]
    rows = _scheduled(docs, block_bytes, weights, source, carried).select("row.doc_id", "row.text_sha256", "source", "block", "slot", "md")
    place = F.row_number().over(Window.partitionBy("slot").orderBy("md")) - 1
    return rows.select("doc_id", "text_sha256", "source", "block", "slot", place.cast("long").alias("position"))


#: The rows of ``slots`` in DuckDB, for blocks of 32768 bytes: windows by the same whole weights, and a recursion over slots
#: that runs the released block with the earliest deadline. c counts the blocks run, by source.
SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS source, strlen(coalesce(text, '')) AS bytes,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS md FROM documents),
w AS (SELECT source, CAST(sum(bytes) AS BIGINT) // 32768 + 1 AS n,
        greatest(1, CAST(floor(sqrt(CAST(256 * sum(bytes) // 32768 AS DOUBLE))) AS BIGINT)) AS weight FROM d GROUP BY source),
g AS (SELECT list_reduce(list(weight), lambda x, y: greatest_common_divisor(x, y)) AS g FROM w),
q AS (SELECT source, n, weight // g AS a FROM w, g),
s AS (SELECT list(source ORDER BY source) AS names, list(a ORDER BY source) AS a, list(n ORDER BY source) AS m, CAST(sum(a) AS BIGINT) AS p, count(*) AS n FROM q),
l AS (SELECT max((q.n * s.p + q.a - 1) // q.a) AS last FROM q, s),
e(t, c, k) AS (
  SELECT CAST(-1 AS BIGINT), list_transform(a, lambda x: CAST(0 AS BIGINT)), CAST(-1 AS BIGINT) FROM s
  UNION ALL
  SELECT t + 1, list_transform(range(1, n + 1), lambda i: c[i] + CASE WHEN pick IS NOT NULL AND i = pick + 1 THEN 1 ELSE 0 END), pick FROM (
    SELECT e.t, e.c, s.n, list_min(list_filter(list_transform(range(1, s.n + 1), lambda i:
        CASE WHEN e.c[i] < s.m[i] AND (e.c[i] * s.p) // s.a[i] <= e.t + 1
             THEN (((e.c[i] + 1) * s.p + s.a[i] - 1) // s.a[i]) * s.n + i - 1 END), lambda y: y IS NOT NULL)) % s.n AS pick
    FROM e, s, l WHERE e.t + 1 < l.last)),
o AS (SELECT s.names[k + 1] AS source, t AS at, row_number() OVER (PARTITION BY k ORDER BY t) - 1 AS i FROM e, s WHERE k >= 0),
b AS (SELECT doc_id, source,
        coalesce(sum(bytes) OVER (PARTITION BY source ORDER BY md ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 32768 AS block FROM d)
SELECT b.doc_id, b.source, CAST(b.block AS BIGINT) AS block, CAST((b.block * s.p) // q.a AS BIGINT) AS release,
       CAST(((b.block + 1) * s.p + q.a - 1) // q.a AS BIGINT) AS deadline, CAST(o.at AS BIGINT) AS slot
FROM b JOIN q ON q.source = b.source JOIN o ON o.source = b.source AND o.i = b.block, s
"""
