"""Embedding near-duplicates by an inverted multi-index.

Two codebooks, one for each half of a vector, form a grid of cells. Every vector is stored in its own cell and, as a query,
visits cells by multi-sequence traversal: the sorted scores of both halves are walked in order of their sum, until the sum
passes the limit that reaches the target recall in calibration. What it meets there is verified by cosine in double precision.
Of two cells only the one of lower number sends its vectors to the other, so a vector travels to half the cells that it visits.

The score of a half is the squared distance to the plane between the own centroid and another, 0 for the own one: a vector
that lies there is at least that far away. Pairs are counted where they are found and never listed: a task returns counts for
each vector and the edges of a spanning forest.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written
from tessera.llm.components import components

#: Vectors that codebooks and the limit are fitted on at most; chosen by digest of label and vector.
FIT_ROWS = 20_000
#: Vectors a cell holds on average, about; codewords of a half at most.
CELL, CODEWORDS = 128, 1024
#: Stored vectors and queries of one cell that a task compares at a time.
STORED, QUERIES = 256, 1024
RECALL = 0.995


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k centroids (fewer if there are fewer different rows); the same rows give the same centroids."""
    rng = np.random.default_rng(0)
    pick = [int(rng.integers(len(x)))]
    near = ((x - x[pick[0]]) ** 2).sum(1)
    while len(pick) < k and near.sum() > 0:
        pick.append(int(rng.choice(len(x), p=near / near.sum())))
        near = np.minimum(near, ((x - x[pick[-1]]) ** 2).sum(1))
    c = x[pick].copy()
    for _ in range(rounds):
        own = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
        n = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return np.unique(c, axis=0)


class Grid:
    """Two codebooks and the limit of the traversal."""

    def __init__(self, sample: np.ndarray, k: int, cosine: float, recall: float):
        self.half = sample.shape[1] // 2
        parts = [p for p in (sample[:, : self.half], sample[:, self.half :]) if p.shape[1]]
        self.books = [kmeans(p, k) for p in parts]
        self.apart = [np.sqrt(np.maximum(((c[:, None] - c[None]) ** 2).sum(2), 1e-30)) for c in self.books]
        self.limit = 0.0
        rng = np.random.default_rng(1)
        base = sample[:4000]
        noise = rng.standard_normal(base.shape)
        noise -= (noise * base).sum(1, keepdims=True) * base
        noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
        moved = cosine * base + np.sqrt(max(0.0, 1 - cosine**2)) * noise  # as far away as a link may be
        pairs = [(base, moved)]
        near = base @ base.T >= cosine
        i, j = np.nonzero(np.triu(near, 1))
        if len(i):
            pairs.append((base[i[:20000]], base[j[:20000]]))
        need = []
        for a, b in pairs:
            s, own = self.scores(a), self.own(b)
            need.append(np.sort(sum(v[np.arange(len(a)), o] for v, o in zip(s, own, strict=True))))
        self.limit = max(float(x[min(len(x) - 1, int(np.ceil(recall * len(x))) - 1)]) for x in need)

    def _halves(self, x: np.ndarray) -> list[np.ndarray]:
        return [p for p in (x[:, : self.half], x[:, self.half :]) if p.shape[1]]

    def own(self, x: np.ndarray) -> list[np.ndarray]:
        return [((c**2).sum(1) - 2 * p @ c.T).argmin(1) for p, c in zip(self._halves(x), self.books, strict=True)]

    def scores(self, x: np.ndarray) -> list[np.ndarray]:
        out = []
        for p, c, apart, own in zip(self._halves(x), self.books, self.apart, self.own(x), strict=True):
            d = (c**2).sum(1) - 2 * p @ c.T
            h = np.maximum(d - d[np.arange(len(p)), own][:, None], 0) / (2 * apart[own])
            h[np.arange(len(p)), own] = 0
            out.append(h**2)
        return out

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
        """Own cell and visited cells, nearest first, of every row; a cell is i * (words of the second half) + j."""
        s = self.scores(x)
        if len(s) == 1:
            return self.own(x)[0], [[int(i) for i in np.argsort(v, kind="stable") if v[i] <= self.limit] for v in s[0]]
        own, width = self.own(x), len(self.books[1])
        order = [np.argsort(v, axis=1, kind="stable") for v in s]
        sorted_ = [np.take_along_axis(v, o, axis=1) for v, o in zip(s, order, strict=True)]
        out = []
        for a, b, oa, ob in zip(sorted_[0].tolist(), sorted_[1].tolist(), order[0].tolist(), order[1].tolist(), strict=True):
            cells, heap, seen = [], [(a[0] + b[0], 0, 0)], {(0, 0)}
            while heap and heap[0][0] <= self.limit:
                _, i, j = heapq.heappop(heap)
                cells.append(oa[i] * width + ob[j])
                for n in ((i + 1, j), (i, j + 1)):
                    if n[0] < len(a) and n[1] < len(b) and n not in seen:
                        seen.add(n)
                        heapq.heappush(heap, (a[n[0]] + b[n[1]], *n))
            out.append(cells)
        return own[0] * width + own[1], out


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    """Vectors of equal length, from their bytes, as unit rows in double precision."""
    x = np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), -1).astype(np.float64)
    big = np.abs(x).max(axis=1, keepdims=True)  # so that very large or small components don't overflow
    x = x / big
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _digested(kind: str, with_vectors: bool):
    """Adds dim and digest of each usable vector, and its bytes or not; whole batches at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            lists = lists.fill_null([]) if lists.null_count else lists
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(kind) + 0.0  # nulls are not finite now; no negative zeros
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            starts = np.concatenate((np.zeros(1, dtype=np.int64), ends[:-1]))
            bad, some = (np.concatenate((np.zeros(1, dtype=np.int64), np.cumsum(x))) for x in (~np.isfinite(flat), flat != 0))
            fine = b.column(2).to_numpy(zero_copy_only=False).astype(bool) & (bad[ends] == bad[starts]) & (some[ends] > some[starts])
            raw, size = flat.tobytes(), flat.dtype.itemsize
            vecs = [raw[i * size : j * size] if k else None for i, j, k in zip(starts.tolist(), ends.tolist(), fine.tolist(), strict=True)]
            digests = [None if v is None else hashlib.blake2b(v, digest_size=16).digest() for v in vecs]
            columns = [b.column(0), b.column(1), pa.array((ends - starts).astype(np.int32), mask=~fine), pa.array(digests, pa.binary())]
            yield pa.record_batch([*columns, *([pa.array(vecs, pa.binary())] if with_vectors else [])], names=["vec_id", "label", "dim", "digest", *(["vec"] if with_vectors else [])])

    return run


def _links(kind: str, cosine: float):
    """Rows sorted by (label, dim, cell, mc, qc, side, rep), stored vectors first: counts and forest edges."""

    def compare(stored: list[pa.RecordBatch], q: pa.RecordBatch) -> pa.RecordBatch | None:
        m = pa.Table.from_batches(stored).combine_chunks()
        mid, qid = m.column("rep").to_numpy(), q.column("rep").to_numpy()
        mn, qn = m.column("n").to_numpy(), q.column("n").to_numpy()
        near = _matrix(q.column("vec"), kind) @ _matrix(m.column("vec").combine_chunks(), kind).T >= cosine
        near &= qid[:, None] != mid[None, :]
        if not near.any():
            return None
        # a stored vector counts the query too, unless it visits the query's cell and counts it there
        visits = m.column("visits").combine_chunks()
        lengths = np.diff(visits.offsets.to_numpy())
        flat = np.repeat(np.arange(len(mid)), lengths) * (1 << 32) + visits.flatten().to_numpy()
        flat.sort()
        own = q.column("own").to_numpy().astype(np.int64)
        key = np.arange(len(mid))[None, :] * (1 << 32) + own[:, None]
        at = np.minimum(np.searchsorted(flat, key), max(0, len(flat) - 1))
        also = near & (flat[at] != key)
        big = np.iinfo(np.int64).max
        label = mid.copy()
        while True:  # least id of each part of the two-sided graph
            ql = np.minimum(np.where(near, label[None, :], big).min(1), np.where(near.any(1), qid, big))
            new = np.minimum(label, np.where(near, ql[:, None], big).min(0))
            if (new == label).all():
                break
            label = new
        qs, ms = near.any(1), near.any(0)
        u = np.concatenate((qid[qs], mid[ms], qid[qs], mid[ms]))
        v = np.concatenate((np.full(qs.sum() + ms.sum(), -1), ql[qs], label[ms]))
        n = np.concatenate(((near @ mn)[qs], (qn @ also)[ms], np.zeros(qs.sum() + ms.sum(), dtype=np.int64)))
        edge = np.concatenate((np.zeros(qs.sum() + ms.sum(), dtype=bool), np.ones(qs.sum() + ms.sum(), dtype=bool)))
        keep = (n > 0) | (edge & (u != v))
        return pa.record_batch([pa.array(u[keep]), pa.array(v[keep], mask=~edge[keep]), pa.array(n[keep].astype(np.int64))], names=["u", "v", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stored = None, []
        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in ("label", "dim", "cell", "mc", "qc", "side")), strict=True))
            start = 0
            for end in range(1, len(keys) + 1):
                if end < len(keys) and keys[end] == keys[start]:
                    continue
                *group, side = keys[start]
                if group != now:
                    now, stored = group, []
                part = b.slice(start, end - start)
                if side == 0:
                    stored.append(part)
                elif stored:
                    for at in range(0, part.num_rows, QUERIES):
                        if (out := compare(stored, part.slice(at, QUERIES))) is not None:
                            yield out
                start = end

    return run


def linked(vectors: DataFrame, cosine: float = 0.93, recall: float = RECALL, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of (vec_id, embedding, label).

    Links join vectors of equal, non-null labels and equal length with cosine >= ``cosine``; none below it is made, and of
    those at it the traversal is set to find the share ``recall``. Equal vectors are compared once and counted as often as they
    occur. Vectors that are null, empty, zero or hold null or non-finite
    components, and rows with a null label or id, link with nothing: 0 links, their own component, kept. Repeated rows are
    vectors of their own; an empty table gives no rows; other columns, whatever their names, are not read. Cells with more than STORED vectors or
    QUERIES queries are dealt out in chunks, so a dense group is compared by many tasks of bounded memory.
    """
    kind = "<f4" if "float" in vectors.schema["embedding"].dataType.simpleString() else "<f8"
    ok = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), ok.alias("ok"), F.col("embedding").cast("array<double>").alias("e"))
    schema = "vec_id long, label string, dim int, digest binary"
    reps = rows.mapInArrow(_digested(kind, True), f"{schema}, vec binary").filter("vec IS NOT NULL").groupBy("label", "digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.any_value("dim").alias("dim"), F.any_value("vec").alias("vec"))
    # rows that share an id but not a vector would share rep: number classes by rep and digest
    reps = written(reps.select("label", "digest", F.col("rep").alias("least"), F.xxhash64("label", "digest").alias("rep"), "n", "dim", "vec"), "vector-classes")
    total, n_labels = reps.agg(F.count("*"), F.countDistinct("label", "dim")).first()
    sample = reps.orderBy("rep").limit(fit_rows).select("dim", "vec").collect()  # bounded by fit_rows
    words = int(np.clip(round(np.sqrt(total / max(1, n_labels) / CELL)), 1, CODEWORDS))
    grids: dict[int, Grid] = {}
    for dim in {r.dim for r in sample}:
        own = pa.array([bytes(r.vec) for r in sample if r.dim == dim], pa.binary())
        grids[dim] = Grid(_matrix(own, kind), words, cosine, recall)
    shared = vectors.sparkSession.sparkContext.broadcast(grids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = b.filter(pa.array(dims == dim))
                n = part.num_rows
                if dim in shared.value:
                    own, visits = shared.value[dim].visits(_matrix(part.column("vec"), kind))
                    own = np.asarray(own, dtype=np.int32)
                    visits = [[c for c in cells if c >= mine] for mine, cells in zip(own.tolist(), visits, strict=True)]
                else:  # a length that the sample lacks: one cell
                    own, visits = np.zeros(n, dtype=np.int32), [[0]] * n
                yield pa.record_batch([*(part.column(c) for c in ("label", "dim", "rep", "n", "vec")), pa.array(own), pa.array(visits, pa.list_(pa.int32()))], names=["label", "dim", "rep", "n", "vec", "own", "visits"])

    placed = reps.select("label", "dim", "rep", "n", "vec").mapInArrow(assign, "label string, dim int, rep long, n long, vec binary, own int, visits array<int>")
    placed = written(placed, "vector-cells")
    stored = placed.select("label", "dim", F.col("own").alias("cell"), F.lit(0).alias("side"), "rep", "n", "vec", "own", "visits")
    queries = placed.select("label", "dim", F.explode("visits").alias("cell"), F.lit(1).alias("side"), "rep", "n", "vec", "own", F.array().cast("array<int>").alias("visits"))
    sizes = stored.groupBy("label", "dim", "cell").agg(F.count("*").alias("ms")).join(queries.groupBy("label", "dim", "cell").agg(F.count("*").alias("qs")), ["label", "dim", "cell"])
    dealt = stored.union(queries).join(written(sizes, "cell-sizes"), ["label", "dim", "cell"])
    mp, qp = F.ceil(F.col("ms") / STORED).cast("int"), F.ceil(F.col("qs") / QUERIES).cast("int")
    mine, every = F.pmod("rep", F.when(F.col("side") == 0, mp).otherwise(qp)).cast("int"), F.sequence(F.lit(0), F.when(F.col("side") == 0, qp).otherwise(mp) - 1)
    dealt = dealt.select("label", "dim", "cell", "side", "rep", "n", "vec", "own", "visits", mine.alias("mine"), F.explode(every).alias("other"))
    mc, qc = (F.when(F.col("side") == s, F.col("mine")).otherwise(F.col("other")) for s in (0, 1))
    key = ["label", "dim", "cell", "mc", "qc"]
    dealt = dealt.select("label", "dim", "cell", mc.alias("mc"), qc.alias("qc"), "side", "rep", "n", "vec", "own", "visits").repartition(*key).sortWithinPartitions(*key, "side", "rep")
    found = written(dealt.mapInArrow(_links(kind, cosine), "u long, v long, n long"), "vector-links")
    counts = found.filter("v IS NULL").groupBy("u").agg(F.sum("n").alias("links"))
    groups = components(found.filter("v IS NOT NULL").select("u", "v"))
    least = groups.join(reps.select("rep", "least"), groups.node == reps.rep).groupBy("component").agg(F.min("least").alias("component_least"))
    groups = groups.join(least, "component").select("node", "component_least")
    classes = reps.join(counts, reps.rep == counts.u, "left").join(groups, reps.rep == groups.node, "left").select(
        F.col("label").alias("cl"), F.col("digest").alias("cd"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component_least", "least").alias("component_id")
    )
    rows = rows.mapInArrow(_digested(kind, False), schema)  # once more, without the vectors
    out = rows.join(classes, (rows.label == F.col("cl")) & (rows.digest == F.col("cd")), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
