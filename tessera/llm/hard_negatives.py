"""Hard negatives of anchors in a table of embeddings, by k-means inverted lists.

Every vector is stored in the list of its nearest centroid, and each centroid knows its list's radius. By the Cauchy-Schwarz
inequality no vector of a list scores above anchor . centroid + |anchor| radius, nor below the same with a minus. An anchor
visits lists by descending bound, in waves of growing size; between waves its kth best score so far becomes known, and lists
whose bound lies strictly below it are not visited, nor those wholly outside the window of scores that a positive allows. Ties go by id, so a
list whose bound equals the kth score is still visited. Within a wave all anchors and lists are one shuffle; lists and visitors
are dealt out in chunks, so a list that holds a third of all vectors is many tasks.

Scores are inner products of whole numbers and exact: in double precision where no sum can pass 2^53, else in Python integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import written
from tessera.llm.embed_dedup import kmeans

#: Vectors that centroids are fitted on at most, chosen by digest of the row.
FIT_ROWS = 20_000
#: Vectors a list holds on average, about; lists at most.
LIST_ROWS, LISTS = 1024, 4096
#: Stored vectors and visitors of one list that a task compares at a time.
STORED, VISITORS = 4096, 512
#: Lists of the first wave; every further wave takes so many times as many.
FIRST_WAVE, GROWTH = 4, 8
#: Bits of a list's set of labels, by which searches for equal labels pass lists by.
LABEL_BITS = 256
#: Widest range of scores that are handed out.
_LONG = (1 << 63) - 1


def matrix(column: pa.Array, width: int = 0) -> np.ndarray:
    """Rows of an Arrow list column as doubles, filled up with zeros to the longest row or ``width``."""
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    starts = np.concatenate((np.zeros(1, dtype=np.int64), ends[:-1])) if len(ends) else ends
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    wide = max(width, int((ends - starts).max(initial=0)))
    out = np.zeros((len(ends), wide))
    within = np.arange(len(flat)) - np.repeat(starts, ends - starts)
    out[np.repeat(np.arange(len(ends)), ends - starts), within] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-numbered rows; where a double can't hold them, as Python integers."""
    d = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, d - x.shape[1]))) for x in (a, b))
    if max(np.abs(a).max(initial=0), 1) * max(np.abs(b).max(initial=0), 1) * max(d, 1) < 2**53:
        return (a @ b.T).astype(np.int64)
    ints = [np.array([[int(v) for v in row] for row in x], dtype=object).reshape(len(x), d) for x in (a, b)]
    return ints[0] @ ints[1].T


class Index:
    """Centroids with the radii of their lists, the number of their vectors and the labels in them."""

    def __init__(self, centroids: np.ndarray, radius: np.ndarray, count: np.ndarray, labels: np.ndarray):
        self.centroids, self.radius, self.count, self.labels = centroids, radius, count, labels

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Most and least score of each row with each list, widened by what rounding may cost."""
        c = np.pad(self.centroids, ((0, 0), (0, max(0, x.shape[1] - self.centroids.shape[1]))))
        x = np.pad(x, ((0, 0), (0, c.shape[1] - x.shape[1])))
        norm = np.sqrt((x**2).sum(1))[:, None]
        mid, reach = x @ c.T, norm * self.radius[None, :]
        slack = 1e-9 * (norm * np.sqrt((c**2).sum(1))[None, :] + reach) + 1e-6
        return mid + reach + slack, mid - reach - slack


def usable(vectors: DataFrame) -> DataFrame:
    """(row, id, label, v) of the rows that take part, by their whole-numbered components; row is a number of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            flat = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * 256)  # nulls become not a number
            ends = np.concatenate((np.zeros(1, dtype=np.int64), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))))
            bad = np.concatenate((np.zeros(1, dtype=np.int64), np.cumsum(~np.isfinite(flat))))[ends]
            whole = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat + 0.0))
            keep = pa.array(np.diff(bad) == 0)
            yield pa.record_batch([c.filter(keep) for c in (b.column(0), b.column(1), whole)], names=["id", "label", "v"])

    rows = vectors.select(F.col("`vec_id`").cast("long").alias("id"), F.col("`label`").cast("long").alias("label"), F.col("`embedding`").cast("array<double>").alias("v"))
    rows = rows.filter("label IS NOT NULL AND v IS NOT NULL")
    moved = F.when(F.coalesce(F.col("id") % 7 == 0, F.lit(False)), (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.withColumn("label", moved).mapInArrow(run, "id long, label long, v array<double>")
    return rows.select(F.monotonically_increasing_id().alias("row"), "id", "label", "v")


def indexed(rows: DataFrame, fit_rows: int = FIT_ROWS, list_rows: int = LIST_ROWS) -> tuple[DataFrame, Index]:
    """Every row with the number of its list, and the index; at most ``LISTS`` lists."""
    spark = rows.sparkSession
    total = rows.count()
    chosen = rows.filter(F.pmod(F.xxhash64("row"), F.lit(max(total, 1))) < 2 * fit_rows)  # about twice as many, before the exact bound
    sample = chosen.orderBy(F.xxhash64("row"), "row").limit(fit_rows).select("v").toArrow()
    width = max(map(len, sample.column("v").to_pylist()), default=0)
    x = matrix(sample.column("v").combine_chunks(), width) if total else np.zeros((1, width))
    big = max(float(np.abs(x).max(initial=0)), 1.0)  # so that squares of large components stay finite
    centroids = kmeans(x / big, int(np.clip(-(-total // list_rows), 1, LISTS))) * big if width else np.zeros((1, 0))
    shared = spark.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(3), shared.value.shape[1])
            c = np.pad(shared.value, ((0, 0), (0, x.shape[1] - shared.value.shape[1])))
            scale = np.maximum(np.abs(x).max(axis=1, initial=1), 1)[:, None]
            own = (((c / scale.max()) ** 2).sum(1) - 2 * (x / scale.max()) @ (c / scale.max()).T).argmin(1)
            away = np.linalg.norm(x - c[own], axis=1)
            yield pa.record_batch([*b.columns, pa.array(own.astype(np.int32)), pa.array(away)], names=[*b.schema.names, "list", "away"])

    stored = written(rows.mapInArrow(assign, "row long, id long, label long, v array<double>, list int, away double"), "lists")
    bit = F.pmod(F.xxhash64("label"), F.lit(LABEL_BITS)).cast("int")
    seen = stored.groupBy("list").agg(F.max("away").alias("radius"), F.count("*").alias("n"), F.collect_set(bit).alias("bits")).collect()  # at most LISTS rows
    radius, count, labels = np.zeros(len(centroids)), np.zeros(len(centroids), dtype=np.int64), np.zeros((len(centroids), LABEL_BITS), dtype=bool)
    for r in seen:
        radius[r.list], count[r.list] = r.radius * (1 + 1e-9), r.n
        labels[r.list, r.bits] = True
    return stored, Index(centroids, radius, count, labels)


def _visits(shared, first: int, last: int, same: bool):
    """One row for each list that an anchor visits in this wave: the anchor with ``list``.

    A search is (low, high, kth): the window of its scores (null where it has no bound) and the kth best found so far (null while
    there are fewer).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in batches:
            for start in range(0, b.num_rows, 1024):
                part = b.slice(start, 1024)
                high, low = index.bounds(matrix(part.column("v"), index.centroids.shape[1]))
                wave = np.argsort(-high, axis=1, kind="stable")[:, first:last]
                go = np.zeros(high.shape, dtype=bool)
                for i, searches in enumerate(part.column("searches").to_pylist()):
                    at = wave[i]
                    some = np.zeros(len(at), dtype=bool)
                    for s in searches:
                        top, least = (high[i, at], low[i, at]) if s["high"] is None else (np.minimum(high[i, at], s["high"]), low[i, at])
                        fits = np.ones(len(at), dtype=bool) if s["kth"] is None else top >= s["kth"]
                        fits &= (s["low"] is None) | (high[i, at] >= (s["low"] or 0))
                        fits &= (s["high"] is None) | (least <= (s["high"] or 0))
                        some |= fits
                    go[i, at] = some & (index.count[at] > 0)
                if same:
                    go &= index.labels[:, part.column("bit").to_numpy()].T
                i, at = np.nonzero(go)
                yield pa.record_batch([*part.take(pa.array(i)).columns, pa.array(at.astype(np.int32))], names=[*part.schema.names, "list"])

    return run


def _best(same: bool, k: int):
    """The best ``k`` of a chunk for each visitor's searches."""

    def order(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> list[int]:
        if scores.dtype == object:
            return sorted(range(len(scores)), key=lambda j: (-scores[j], ids[j], rows[j]))
        return np.lexsort((rows, ids, -scores)).tolist()

    def run(stored: pa.Table, visitors: pa.Table) -> pa.Table:
        out = []
        if stored.num_rows and visitors.num_rows:
            x, q = (matrix(f.column("v").combine_chunks()) for f in (stored, visitors))
            real = stored.column("id").to_pylist()
            ids = np.array([_LONG if i is None else i for i in real], dtype=np.int64)
            rows, labels = stored.column("row").to_numpy(), stored.column("label").to_numpy()
            for anchor, label, searches, scores in zip(*(visitors.column(c).to_pylist() for c in ("row", "label", "searches")), products(q, x), strict=True):
                fits = (labels == label) & (rows != anchor) if same else labels != label
                for n, s in enumerate(searches):
                    least = max((v for v in (s["low"], s["kth"]) if v is not None), default=None)
                    mine = fits if least is None else fits & (scores >= least)
                    own = np.flatnonzero(mine if s["high"] is None else mine & (scores <= s["high"]))
                    if len(own) > k and scores.dtype != object:
                        own = own[scores[own] >= np.partition(scores[own], len(own) - k)[len(own) - k]]
                    for j in own[order(scores[own], ids[own], rows[own])[:k]].tolist():
                        out.append((anchor, n, rows[j], real[j], max(-_LONG, min(_LONG, int(scores[j])))))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.table([pa.array([r[c] for r in out], kind) for c, kind in enumerate(kinds)], names=["anchor", "search", "other", "other_id", "score"])

    return run


def _searched(anchors: DataFrame, stored: DataFrame, index: Index, k: int, same: bool, first_wave: int) -> DataFrame:
    """(anchor, search, other, other_id, score, rank): the first ``k`` of every search of ``anchors`` (row, label, v, searches)."""
    spark = anchors.sparkSession
    shared = spark.sparkContext.broadcast(index)
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in anchors.schema)
    found, first, last, lists = None, 0, first_wave, len(index.centroids)
    order = Window.partitionBy("anchor", "search").orderBy(F.col("score").desc(), F.col("other_id").asc_nulls_last(), "other")
    while first < lists:
        visits = written(anchors.mapInArrow(_visits(shared, first, last, same), f"{kind}, list int"), "visits")
        come = {r.list: r.n for r in visits.groupBy("list").agg(F.count("*").alias("n")).collect()}  # at most LISTS rows
        if come:
            found = _compared(visits, stored, index, come, k, same, found, order)
            kth = found.filter(F.col("rank") == k).select("anchor", F.col("search").alias("n"), "score")
            kth = kth.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("n", "score"))).alias("scores"))
            reached = anchors.join(kth, F.col("row") == F.col("anchor"), "left")
            search = F.transform("searches", lambda s, i: F.struct(s["low"].alias("low"), s["high"].alias("high"), F.coalesce(F.try_element_at("scores", i), s["kth"]).alias("kth")))
            anchors = written(reached.withColumn("searches", search).select(*anchors.columns), "anchors")
        first, last = last, last + (last - first) * GROWTH
    if found is None:
        return spark.createDataFrame([], "anchor long, search int, other long, other_id long, score long, rank int")
    return found


def _compared(visits: DataFrame, stored: DataFrame, index: Index, come: dict[int, int], k: int, same: bool, before: DataFrame | None, order) -> DataFrame:
    """The best of one wave's visits, together with those found before."""
    spark = visits.sparkSession
    dealt = [(n, -(-int(index.count[n]) // STORED), -(-v // VISITORS)) for n, v in come.items()]
    chunks = F.broadcast(spark.createDataFrame(dealt, "list int, chunks int, parts int"))  # at most LISTS rows
    mine = stored.join(chunks, "list").select("list", F.pmod(F.xxhash64("row"), "chunks").cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "row", "id", "label", "v")
    come_by = visits.join(chunks, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.pmod(F.xxhash64("row"), "parts").cast("int").alias("part"), "row", "label", "v", "searches")
    key = ["list", "chunk", "part"]
    new = mine.groupBy(*key).cogroup(come_by.groupBy(*key)).applyInArrow(_best(same, k), "anchor long, search int, other long, other_id long, score long")
    every = new if before is None else new.union(before.select(*new.columns))
    return written(every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "found")


def mined(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, fit_rows: int = FIT_ROWS, list_rows: int = LIST_ROWS, first_wave: int = FIRST_WAVE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for (vec_id, embedding, label).

    Rows with a null label, a null vector or a null or non-finite component take no part. Anchors are rows whose id is divisible
    by ``every``; their positives are the first ``positives`` other rows of their label; each positive has the first
    ``negatives`` rows of other labels with low positive_score <= 100 negative_score <= high positive_score, if any.

    Rows of a null id are never anchors; as positives and negatives they come last among equal scores. Repeated rows are rows of their
    own, with ranks of their own, also as anchors. Of vectors of different lengths the shorter is filled up with zeros; an empty
    vector scores 0. Components times 256 beyond doubles count as non-finite; scores beyond 64 bits are cut to them.
    An empty table gives no rows; other columns, whatever their names, are not read.
    """
    rows = written(usable(vectors), "usable-vectors")
    stored, index = indexed(rows, fit_rows, list_rows)
    search = "array<struct<low:bigint,high:bigint,kth:bigint>>"
    every_score = F.array(F.struct(*[F.lit(None).cast("long").alias(n) for n in ("low", "high", "kth")])).cast(search)
    bit = F.pmod(F.xxhash64("label"), F.lit(LABEL_BITS)).cast("int")
    anchors = written(stored.filter(F.col("id") % every == 0).select("row", "id", "label", "v", bit.alias("bit"), every_score.alias("searches")), "anchors")
    near = _searched(anchors, stored, index, positives, True, first_wave)
    near = near.select("anchor", F.col("other_id").alias("positive_id"), F.col("rank").alias("place"), F.col("score").alias("positive_score"))
    # one search for each different score of the anchor's positives; none where no score can lie in the window
    score = F.col("positive_score").cast("decimal(20,0)")
    windows = near.select("anchor", "positive_score", F.ceil(score * low / 100).cast("long").alias("low"), F.floor(score * high / 100).cast("long").alias("high"))
    one = F.struct("low", "high", F.lit(None).cast("long").alias("kth"), "positive_score")
    windows = windows.filter("low <= high").distinct().groupBy("anchor").agg(F.sort_array(F.collect_list(one)).alias("windows"))  # at most ``positives`` each
    asked = written(anchors.drop("searches").join(windows, F.col("row") == F.col("anchor")), "windows")
    plain = asked.select("row", "id", "label", "v", "bit", F.transform("windows", lambda w: F.struct(w["low"].alias("low"), w["high"].alias("high"), w["kth"].alias("kth"))).alias("searches"))
    hard = _searched(plain, stored, index, negatives, False, first_wave)
    scores = asked.select(F.col("anchor").alias("a"), F.col("id").alias("anchor_id"), F.posexplode(F.transform("windows", lambda w: w["positive_score"])).alias("n", "score_of"))
    hard = hard.join(scores, (F.col("anchor") == F.col("a")) & (F.col("search") == F.col("n"))).select("a", "anchor_id", "score_of", "rank", F.col("other_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = near.join(hard, (F.col("anchor") == F.col("a")) & (F.col("positive_score") == F.col("score_of")))
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score", F.col("place").cast("int").alias("positive_rank"))


#: DuckDB's twin, by comparing every anchor with every row; equal ids and vectors of different lengths are tested elsewhere.
SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS positive_rank
  FROM scores WHERE same),
found AS (
  SELECT p.anchor_id, p.positive_id, p.positive_score, p.positive_rank, s.other_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS rank
  FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
  WHERE p.positive_rank <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score, CAST(positive_rank AS INTEGER) AS positive_rank FROM found WHERE rank <= 10
"""
