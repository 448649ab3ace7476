"""SimHash near-duplicates: fingerprints of 4-word shingles, linked within a Hamming radius by bit-sliced comparison.

Candidates: 64 bits in 6 blocks; two fingerprints at 4 or fewer differing bits agree on at least two whole blocks, so the
15 pairs of blocks as keys lose no link. Within the rows of one key, fingerprints are held as vertical bit planes: shifting
the planes by d lanes and XOR-ing compares every lane with the one d further on at once, a carry-save counter of three
bits and an overflow bit adds the 64 difference planes, and a block of lanes is abandoned once all its lanes overflow.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import whole_text, written
from tessera.llm.components import components

BITS = 64
#: (low bit, width) of the six blocks.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
#: Runs up to this many rows are compared by shifting planes; longer ones query by query against blocks of lanes.
SHORT_RUN = 24
#: Rows of one key that one task compares with as many others at most; longer runs are dealt out as pairs of chunks.
CHUNK = 8192


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 65536):  # bounded memory for very long texts
        part = hashes[at : at + 65536]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """The unsigned 64-bit fingerprint; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, seed)], dtype=np.uint64)
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate(([0], ends[:-1]))
        view, digest = memoryview(joined), xxhash.xxh64_intdigest
        n = len(words) - shingle + 1
        hashes = np.fromiter((digest(view[a:b], seed) for a, b in zip(starts[:n].tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)), dtype=np.uint64, count=n)
    return majority(hashes)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        values = np.array([fingerprint(t) for t in b.column(2).to_pylist()], dtype=np.uint64)
        yield pa.record_batch([b.column(0), b.column(1), pa.array(values.view(np.int64))], names=["doc_id", "th", "fp"])


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, th, fp): a hash that tells texts of one doc_id apart, and the fingerprint's bits as a signed long."""
    text = whole_text("`text`")
    return docs.select(F.col("`doc_id`").cast("long"), F.xxhash64(text).alias("th"), text.alias("text")).mapInArrow(_fingerprints, "doc_id long, th long, fp long")


def planes(fps: np.ndarray) -> np.ndarray:
    """Vertical form: (64, words) of uint64; lane i is bit i % 64 of word i // 64."""
    words = -(-len(fps) // 64)
    lanes = np.zeros(words * 64, dtype="<u8")
    lanes[: len(fps)] = fps
    bits = np.unpackbits(lanes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def _within(diff, words: int, radius: int) -> np.ndarray:
    """Lanes (packed) whose 64 difference planes, given one by one as diff(b, live words), have at most ``radius`` ones.

    Carry-save: ones, twos, fours are the counter's planes, over marks lanes past 7. Every 8 planes the words whose lanes
    all exceed the radius are dropped.
    """
    live = np.arange(words)
    ones, twos, fours, over = (np.zeros(words, dtype=np.uint64) for _ in range(4))
    for b in range(BITS):
        d = diff(b, live)
        carry = ones & d
        ones = ones ^ d
        carry, twos = twos & carry, twos ^ carry
        carry, fours = fours & carry, fours ^ carry
        over = over | carry
        if b % 8 == 7:
            far = _beyond(ones, twos, fours, over, radius)
            keep = far != np.uint64(0xFFFFFFFFFFFFFFFF)
            if not keep.any():
                return np.zeros(words, dtype=np.uint64)
            if not keep.all():
                live, ones, twos, fours, over = live[keep], ones[keep], twos[keep], fours[keep], over[keep]
    out = np.zeros(words, dtype=np.uint64)
    out[live] = ~_beyond(ones, twos, fours, over, radius)
    return out


def _beyond(ones, twos, fours, over, radius: int):
    """Lanes whose count is over the radius (0 to 6), by comparing the counter's bit planes with it."""
    more, same = over.copy(), ~over
    for plane, weight in ((fours, 4), (twos, 2), (ones, 1)):
        if radius & weight:
            same = same & plane
        else:
            more = more | (same & plane)
            same = same & ~plane
    return more


def _lanes(packed: np.ndarray, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(packed.astype("<u8").view(np.uint8), bitorder="little")[:n])


def near_by_shift(fps: np.ndarray, runs: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i, j) with runs[i] == runs[j] within the radius; ``runs`` is sorted and its runs are short."""
    n = len(fps)
    longest = int(np.unique(runs, return_counts=True)[1].max(initial=0))
    p, left, right = planes(fps), [], []
    for d in range(1, longest):
        same = np.zeros(n, dtype=bool)
        same[: n - d] = runs[d:] == runs[:-d]
        if not same.any():
            break
        word, bit = divmod(d, 64)

        def diff(b, live, word=word, bit=bit):
            row = np.concatenate((p[b], np.zeros(word + 2, dtype=np.uint64)))
            other = row[live + word] >> np.uint64(bit)
            if bit:
                other = other | (row[live + word + 1] << np.uint64(64 - bit))
            return p[b][live] ^ other

        at = _lanes(_within(diff, p.shape[1], radius), n)
        at = at[same[at]]
        left.append(at)
        right.append(at + d)
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def near_by_query(queries: np.ndarray, fps: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each query, the lanes of ``fps`` within the radius."""
    p, everything = planes(fps), np.uint64(0xFFFFFFFFFFFFFFFF)
    for i, q in enumerate(queries.tolist()):
        yield i, _lanes(_within(lambda b, live, q=q: p[b][live] ^ (everything if q >> b & 1 else np.uint64(0)), p.shape[1], radius), len(fps))


class Forest:
    """Union-find over positions; keeps the edges that join two trees, so a dense run yields no more edges than rows."""

    def __init__(self, n: int):
        self.up, self.edges = list(range(n)), []

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.edges.append((i, j))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        parts = [(fps >> np.uint64(low)) & np.uint64((1 << width) - 1) for low, width in BLOCKS]
        keys = np.empty((len(fps), 15), dtype=np.int64)
        for k, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2)):
            keys[:, k] = (np.uint64(k) << np.uint64(32) | parts[i] << np.uint64(11) | parts[j]).astype(np.int64)
        yield pa.record_batch([pa.array(keys.ravel()), pa.array(np.repeat(fps, 15).view(np.int64))], names=["k", "fp"])


def _edges_of(rows: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (k, a, b, side, fp): edges of each group, its side 0 against itself or against side 1."""

    def out(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["fu", "fv"])

    def dense(own: np.ndarray, other: np.ndarray | None) -> pa.RecordBatch:
        every = own if other is None else np.concatenate((own, other))
        base, forest = 0 if other is None else len(own), Forest(len(every))
        for i, lanes in near_by_query(own, own if other is None else other, radius):
            for j in lanes.tolist():
                if i != j + base:
                    forest.join(i, j + base)
        at = np.array(forest.edges, dtype=np.int64).reshape(-1, 2)
        return out(every[at[:, 0]], every[at[:, 1]])

    def done(group: np.ndarray, side: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole groups only."""
        starts = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1))
        sizes = np.diff(np.concatenate((starts, [len(group)])))
        short = (sizes <= SHORT_RUN) & (np.add.reduceat(side, starts) == 0)
        rows = np.repeat(short & (sizes > 1), sizes)
        for at in range(0, int(rows.sum()), 1 << 18):
            pick = np.flatnonzero(rows)
            # a slice may cut a run: it is widened to whole runs by taking the runs that start in it
            g = group[pick]
            first = np.searchsorted(g, g[at], "left")
            last = np.searchsorted(g, g[min(len(g) - 1, at + (1 << 18) - 1)], "right")
            i, j = near_by_shift(fps[pick[first:last]], g[first:last], radius)
            if len(i):
                yield out(fps[pick[first:last]][i], fps[pick[first:last]][j])
        for s, n in zip(starts[~short].tolist(), sizes[~short].tolist(), strict=True):
            f, d = fps[s : s + n], side[s : s + n]
            yield dense(f[d == 0], f[d == 1] if d.any() else None)

    kept: list[np.ndarray] | None = None
    number = 0  # of the last group seen
    last: tuple | None = None
    for b in rows:
        if not b.num_rows:
            continue
        k, a, c, side, fps = (b.column(n).to_numpy(zero_copy_only=False) for n in ("k", "a", "b", "side", "fp"))
        change = np.concatenate(([last is not None and last != (k[0], a[0], c[0])], (np.diff(k) != 0) | (np.diff(a) != 0) | (np.diff(c) != 0)))
        group = number + np.cumsum(change)
        number, last = int(group[-1]), (k[-1], a[-1], c[-1])
        now = [group, side.astype(np.int64), fps.view(np.uint64)]
        kept = now if kept is None else [np.concatenate(x) for x in zip(kept, now, strict=True)]
        cut = int(np.searchsorted(kept[0], number, "left"))  # the last group may go on
        if cut >= 1 << 16:
            yield from done(*(x[:cut] for x in kept))
            kept = [x[cut:] for x in kept]
    if kept is not None:
        yield from done(*kept)


def near_edges(distinct_fps: DataFrame, radius: int = 4, chunk: int = CHUNK) -> DataFrame:
    """(fu, fv): links between different fingerprints of column fp that join the same groups as all links do.

    Every two fingerprints within the radius are compared; of the links in one run of a key only those that join two parts
    are kept. A key with more than ``chunk`` rows is dealt out as pairs of chunks, so no task holds an unbounded group.
    """
    if not 0 <= radius <= 4:
        raise ValueError("two of six blocks agree only up to radius 4")
    keyed = distinct_fps.select("fp").mapInArrow(_keyed, "k long, fp long")
    counts = keyed.groupBy("k").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    rows = keyed.join(counts, "k")
    parts = F.ceil(F.col("n") / chunk).cast("int")
    own = F.pmod(F.xxhash64("fp"), parts).cast("int")
    mine = F.struct(own.alias("a"), own.alias("b"), F.lit(0).alias("side"))
    others = F.transform(
        F.filter(F.sequence(F.lit(0), parts - 1), lambda x: x != own),
        lambda x: F.struct(F.least(x, own).alias("a"), F.greatest(x, own).alias("b"), F.when(own < x, 0).otherwise(1).alias("side")),
    )
    dealt = rows.select("k", "fp", F.explode(F.when(parts > 1, F.concat(F.array(mine), others)).otherwise(F.array(mine))).alias("p")).select("k", "p.a", "p.b", "p.side", "fp")
    dealt = dealt.repartition("k", "a", "b").sortWithinPartitions("k", "a", "b", "side", "fp")
    return dealt.mapInArrow(lambda it: _edges_of(it, radius), "fu long, fv long").distinct()


def _grouped(docs: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of all rows, and (fp, grp, component_id): grp is the same for all fingerprints of a component."""
    fps = written(with_fingerprints(docs), "fingerprints")
    distinct_fps = written(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct-fingerprints")
    links = near_edges(distinct_fps, radius)
    groups = components(links.select(F.col("fu").alias("u"), F.col("fv").alias("v")))
    least = groups.join(distinct_fps, groups.node == distinct_fps.fp).groupBy("component").agg(F.min("rep").alias("least"))
    joined = groups.join(least, "component").select(F.col("node").alias("fp"), F.col("component"), "least")
    grp = F.coalesce("component", "fp").alias("grp")
    return fps, distinct_fps.join(joined, "fp", "left").select("fp", grp, F.when(F.col("component").isNull(), F.col("rep")).otherwise(F.col("least")).alias("component_id"))


def near_duplicates(docs: DataFrame, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id, text).

    component_id is the least doc_id reachable by links, itself included. Null or wordless texts have fingerprint zero and
    are linked like any other; repeated rows come out as often as they come in; an empty table gives no rows; a null doc_id
    gets the least doc_id of its group, null if there is none. Other columns, whatever their names, are not read. A very long
    text costs memory by its length.
    """
    fps, classes = _grouped(docs, radius)
    return fps.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, radius: int = 4) -> DataFrame:
    """One row of ``docs`` for each near-duplicate group, all its columns: that with the least doc_id (null ids last; of
    several texts with that id, the least hash; of equal rows, one).

    The winners are found among rows of three numbers, so that a hot group moves no texts; the texts are shuffled once, by
    doc_id and hash.
    """
    fps, classes = _grouped(docs, radius)
    return least_of_groups(docs, fps.join(classes, "fp"))


def least_of_groups(docs: DataFrame, rows_of_groups: DataFrame) -> DataFrame:
    """The row of ``docs`` that ``representatives`` describes, for each grp of (doc_id, th, grp)."""
    best = rows_of_groups.groupBy("grp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("b"))
    best = best.select(F.col("b.doc_id").alias("best_id"), F.col("b.th").alias("best_th"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("`doc_id`").cast("long").alias("own_id"), F.xxhash64(whole_text("`text`")).alias("own_th"))
    kept = rows.join(best, F.col("own_id").eqNullSafe(F.col("best_id")) & (F.col("own_th") == F.col("best_th")), "left_semi").dropDuplicates(["own_id", "own_th"])
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
