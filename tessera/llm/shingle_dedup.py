"""Near-duplicates by SimHash fingerprints and the Jaccard similarity of 5-word shingles: every link is verified exactly.

Candidates come from two sources. First the fingerprints of the 5-word shingles, compared bit-sliced as in ``simhash``: what is
linked within ``RADIUS`` bits makes a bucket. At similarity 0.8 fingerprints differ in about ten bits, though, beyond what blocks
can find, so MinHash bands find the links of texts whose fingerprints lie further apart: two texts of similarity 0.8 agree on a
band of four minima with probability 0.8 ** 4 = 0.41, so they share none of 20 bands with probability 0.00003.

The pairs of a bucket are checked in two steps. First each text against one of them, the one
with the most bucket-mates in all buckets, as the origin of a group of copies has: this joins most of a large group with a number
of checks in proportion to its size. Then all other pairs of a bucket that aren't in one component yet and whose fingerprints
are within the radius (buckets of fingerprints), or whose 80 minima
agree in 60 % at least (buckets of bands; 4.5 standard deviations below 0.8): these are compared inside the tasks that hold a
bucket's shingle sets, so no pair becomes a row; a task returns the edges of a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import simhash
from tessera.llm.common import whole_text, written
from tessera.llm.components import components

SHINGLE, BANDS, ROWS = 5, 20, 4
#: Differing bits up to which fingerprints are linked.
RADIUS = 4
#: Agreeing minima from which a pair of a band's bucket is verified in the second step.
AGREEING = 48
#: Rows of one bucket that one task compares with as many others at most, and bytes of their shingle sets, about.
CHUNK, CHUNK_BYTES = 2048, 16 << 20
#: Rows (of some 40 bytes) up to which a side of a join with texts is broadcast.
BROADCAST_ROWS = 200_000
#: Texts that a worker unpacks at a time.
SLICE = 512

_rng = np.random.default_rng(42)
_A = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def hashed(text: str | None) -> tuple[int, np.ndarray]:
    """A hash of the lower-case words, and the hashes of their shingles, repeats included: one of all words if they are few."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return digest(joined), np.array([digest(joined, 42)], dtype=np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1])).tolist()
    view = memoryview(joined)
    found = [digest(view[a:b], 42) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist(), strict=False)]
    return digest(joined), np.array(found, dtype=np.uint64)


def shingles(text: str | None) -> tuple[int, np.ndarray]:
    """A hash of the lower-case words, and the sorted distinct hashes of their shingles."""
    node, hashes = hashed(text)
    return node, np.unique(hashes)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of each of BANDS * ROWS hash functions, 32 bits."""
    out = np.full(BANDS * ROWS, 2**32 - 1, dtype=np.uint64)
    for at in range(0, len(hashes), 1024):  # stays within the processor's cache
        np.minimum(out, ((hashes[None, at : at + 1024] * _A[:, None] + _B[:, None]) >> np.uint64(32)).min(axis=1), out=out)
    return out.astype("<u4")


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard similarity of 0.8 at least, in whole numbers."""
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            yield b.slice(at, SLICE)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _slices(batches):
        nodes, sigs, fps = [], [], []
        for text in b.column(2).to_pylist():
            node, hashes = hashed(text)
            nodes.append(node)
            sigs.append(minima(np.unique(hashes)).tobytes())
            fps.append(simhash.majority(hashes))
        nodes, fps = (pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (nodes, fps))
        yield pa.record_batch([b.column(0), b.column(1), nodes, pa.array(sigs, pa.binary()), fps], names=["doc_id", "th", "node", "sig", "fp"])


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        width = 4 * ROWS
        keys = np.array([xxhash.xxh64_intdigest(s[k * width : (k + 1) * width], k) for s in b.column(1).to_pylist() for k in range(BANDS)], dtype=np.uint64)
        band, node = np.tile(np.arange(BANDS, dtype=np.int32), b.num_rows), np.repeat(b.column(0).to_numpy(zero_copy_only=False), BANDS)
        yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(band), pa.array(node)], names=["k", "band", "node"])


def _fingerprint_buckets(nodes: DataFrame) -> DataFrame:
    """(k, band, node): nodes whose fingerprints are equal or linked, directly or over others; they count as a band after the last."""
    links = simhash.near_edges(written(nodes.select("fp").distinct(), "shingle-fingerprints"), RADIUS)
    near = components(links.select(F.col("fu").alias("u"), F.col("fv").alias("v"))).withColumnRenamed("node", "fp")
    return nodes.select("node", "fp").join(near, "fp", "left").select(F.coalesce("component", "fp").alias("k"), F.lit(BANDS).alias("band"), "node")


def _close(group: pa.Table) -> pa.Table:
    """(u, v): edges that join the components of one dealt group wherever two of its texts are similar and their fingerprints linked
    or their minima alike. Pairs with the leader were checked before, and pairs of a band that share an earlier one are checked
    there."""
    node, comp, side, leader, band = (group.column(c).to_numpy() for c in ("node", "comp", "side", "leader", "band"))
    sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), dtype="<u4").reshape(len(node), -1)
    sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in group.column("shingles")]
    fps = group.column("fp").to_numpy().view(np.uint64)
    crossed, up, edges = bool(side.any()), {}, []

    def find(c: int) -> int:
        while up.get(c, c) != c:
            up[c] = c = up.get(up[c], up[c])
        return c

    for i in range(len(node)):
        if node[i] == leader[i] or (crossed and side[i]):
            continue
        others = np.flatnonzero((comp != comp[i]) & (node != leader) & ((side == 1) if crossed else (node > node[i])))
        if band[i] == BANDS:
            others = others[np.bitwise_count(fps[others] ^ fps[i]) <= RADIUS]
        else:
            same = sig[others] == sig[i]
            first = ~same.reshape(len(others), BANDS, ROWS).all(axis=2)[:, : band[i]].any(axis=1)
            others = others[first & (same.sum(axis=1) >= AGREEING)]
        for j in others.tolist():
            a, b = find(int(comp[i])), find(int(comp[j]))
            if a != b and similar(sets[i], sets[j]):
                up[max(a, b)] = min(a, b)
                edges.append((min(node[i], node[j]), max(node[i], node[j])))
    found = np.array(edges, dtype=np.int64).reshape(-1, 2)
    return pa.table({"u": found[:, 0], "v": found[:, 1]})


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, own = None, None
    for b in _slices(batches):
        keep = []
        for u, text, other in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            if u != last:
                last, own = u, shingles(text)[1]
            keep.append(similar(own, shingles(other)[1]))
        yield pa.record_batch([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _slices(batches):
        sets = [shingles(t)[1].tobytes() for t in b.column(1).to_pylist()]
        yield pa.record_batch([b.column(0), pa.array(sets, pa.binary()), pa.array(map(len, sets), pa.int64())], names=["node", "shingles", "size"])


def _texts(wanted: DataFrame, docs: DataFrame, first: DataFrame, name: str) -> DataFrame:
    """(node, text) of the nodes in ``wanted``; ``first`` has a row (node, doc_id, th) of each node."""
    wanted = written(first.join(wanted.select("node").distinct(), "node", "left_semi"), f"{name}-nodes")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    text = whole_text("`text`")
    rows = docs.select(F.col("`doc_id`").cast("long").alias("own_id"), F.xxhash64(text).alias("own_th"), text.alias("text"))
    return rows.join(wanted, F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_th") == F.col("th"))).select("node", "text").dropDuplicates(["node"])


def _links(pairs: DataFrame, docs: DataFrame, first: DataFrame, name: str) -> DataFrame:
    """The pairs (u, v) of nodes whose texts are similar."""
    texts = written(_texts(pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))), docs, first, name), f"{name}-texts")
    both = pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("tu")), "u").join(texts.select(F.col("node").alias("v"), F.col("text").alias("tv")), "v")
    return written(both.select("u", "v", "tu", "tv").sortWithinPartitions("u").mapInArrow(_verified, "u long, v long"), f"{name}-links")


def _rest(members: DataFrame, nodes: DataFrame, docs: DataFrame, chunk: int) -> DataFrame:
    """(u, v): edges between components, from all pairs of each bucket with several of them. A bucket with more than ``chunk``
    rows, or ``CHUNK_BYTES`` of shingles, is dealt out as pairs of its parts."""
    mixed = members.groupBy("k").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).filter("a <> b").select("k")
    rows = written(members.filter("n > 2").join(mixed, "k", "left_semi"), "shingle-mixed")
    sets = written(_texts(rows, docs, nodes.select("node", "doc_id", "th"), "mixed").mapInArrow(_sets, "node long, shingles binary, size long"), "shingle-sets")
    sized = rows.join(sets.select("node", "size"), "node")
    parts = F.greatest(F.ceil(F.max("n") / chunk), F.ceil(F.sum("size") / CHUNK_BYTES)).cast("int")
    rows = rows.join(sized.groupBy("k").agg(parts.alias("parts")), "k")
    own, parts = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"), F.col("parts")
    others = F.transform(
        F.filter(F.sequence(F.lit(0), parts - 1), lambda x: x != own),
        lambda x: F.struct(F.least(x, own).alias("a"), F.greatest(x, own).alias("b"), F.when(own < x, 0).otherwise(1).alias("side")),
    )
    mine = F.array(F.struct(own.alias("a"), own.alias("b"), F.lit(0).alias("side")))
    dealt = rows.select("k", "band", "leader", "node", "comp", F.explode(F.concat(mine, others)).alias("p")).select("k", "band", "p.a", "p.b", "p.side", "leader", "node", "comp")
    dealt = dealt.join(sets.select("node", "shingles"), "node").join(nodes.select("node", "sig", "fp"), "node")
    return dealt.groupBy("k", "a", "b").applyInArrow(_close, "u long, v long")


def grouped(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, th, grp) for every row of ``docs`` (doc_id, text): th is the text's hash, grp its near-duplicate group.

    Null texts are empty; texts of equal words (none included) are one group; equal rows have equal values; null doc_ids stay
    null; an empty table gives no rows; other columns, whatever their names, are not read. A very long text costs memory by
    its length.
    """
    text = whole_text("`text`")
    signed = docs.select(F.col("`doc_id`").cast("long"), F.xxhash64(text).alias("th"), text.alias("text")).mapInArrow(_signed, "doc_id long, th long, node long, sig binary, fp long")
    signed = written(signed, "shingle-minima")
    nodes = signed.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th", "sig", "fp")).alias("b"))
    nodes = written(nodes.select("node", "b.doc_id", "b.th", "b.sig", "b.fp"), "shingle-nodes")
    keyed = nodes.select("node", "sig").mapInArrow(_banded, "k long, band int, node long").union(written(_fingerprint_buckets(nodes), "shingle-near"))
    shared = keyed.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1")
    members = written(keyed.join(shared, "k"), "shingle-buckets")
    weight = members.groupBy("node").agg(F.sum("n").alias("mates"))
    leaders = members.join(weight, "node").groupBy("k").agg(F.max(F.struct("mates", "node"))["node"].alias("leader"))
    members = written(members.join(leaders, "k"), "shingle-leaders")
    stars = members.filter("node <> leader").select(F.least("leader", "node").alias("u"), F.greatest("leader", "node").alias("v")).distinct()
    links = _links(written(stars, "shingle-stars"), docs, nodes.select("node", "doc_id", "th"), "star")
    found = components(links).withColumnRenamed("component", "comp")
    members = members.join(found, "node", "left").select("k", "band", "n", "leader", "node", F.coalesce("comp", "node").alias("comp"))
    rest = written(_rest(members, nodes, docs, chunk), "shingle-rest")
    groups = components(links.union(rest))
    return signed.join(groups, "node", "left").select("doc_id", "th", F.coalesce("component", "node").alias("grp"))
