"""Quality scores: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader updates.

A text's words and runs of signs are hashed singly and in pairs. Beside the words themselves, their patterns are hashed in runs
of one to three: a pattern is the kind of each word (small, capital, shouted, digits, signs and so on) and whether it repeats
the word before. So the model knows texts whose words it has never seen. Words and patterns are one sparse vector each, of
length one, and a score is the sparse dot product of both with the weights.

Training is follow-the-regularised-leader with per-coordinate rates and both penalties, in shards: each task runs through the
rows of its shard from the common state, and the states of all shards are averaged, a few times over.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import held_out, whole_text, written

#: Labelled rows that the weights are fitted on at most; chosen by digest of the id, so evenly over the table.
FIT_ROWS = 20_000
#: Rows of a shard; rounds of training and averaging.
SHARD_ROWS, ROUNDS = 2_500, 6
#: Buckets of the hashed vectors.
BITS = 18
BUCKETS = 1 << BITS
#: Rate, its damping, and the two penalties of the updates.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.02
#: Rows with crc32(doc_id as text) mod PARTS = PART are held out.
PARTS, PART = 3, 1

_TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")
_KINDS = 8


def _kind(word: str) -> int:
    """Kind of a token: 0 small letters, 1 capital, 2 shouted, 3 mixed case, 4 with digits, 5 one sign, 6 several, 7 without case."""
    if not word[0].isalnum():
        return 5 if len(word) == 1 else 6
    if not word.isalpha():
        return 4
    if word.islower():
        return 0
    if word.isupper():
        return 2 if len(word) > 1 else 1
    return 1 if word.istitle() else 3 if word != word.lower() else 7


class Words(dict):
    """Hash (upper bits) and kind (lowest three) of every token asked for, remembered within bounds."""

    def __missing__(self, word: str) -> int:
        got = zlib.crc32(word.encode("utf-8", "surrogatepass")) * _KINDS + _kind(word)
        if len(self) > 300_000:
            self.clear()
        if len(word) < 64:
            self[word] = got
        return got


def _unit(hashed: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of one sparse vector of length one: roots of the counts."""
    keys = np.concatenate(hashed) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)
    at, count = np.unique(keys, return_counts=True)
    value = np.sqrt(count)
    return at.astype(np.int32), (value / max(1.0, float(np.linalg.norm(value)))).astype(np.float32)


def vector(text: str, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a text, with the constant term in bucket 0; a text without words or signs has only that one."""
    token = np.fromiter(map(words.__getitem__, _TOKEN.findall(text)), dtype=np.uint64, count=-1)
    one = np.zeros(1, dtype=np.int32), np.ones(1, dtype=np.float32)
    if not len(token):
        return one
    a, b = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    pair = token[:-1] * a + token[1:] * b
    kind = token % np.uint64(_KINDS)
    kind[1:] += np.uint64(_KINDS) * (token[1:] == token[:-1])
    two = kind[:-1] * np.uint64(16) + kind[1:] + np.uint64(1 << 40)
    three = kind[:-2] * np.uint64(256) + kind[1:-1] * np.uint64(16) + kind[2:] + np.uint64(1 << 41)
    parts = [one, _unit([token, pair]), _unit([kind + np.uint64(1 << 42), two, three])]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


class Leader:
    """State of the updates: ``z`` and ``n`` of every bucket; weights follow from them."""

    def __init__(self, z: np.ndarray | None = None, n: np.ndarray | None = None):
        self.z = np.zeros(BUCKETS) if z is None else z
        self.n = np.zeros(BUCKETS) if n is None else n

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def update(self, at: np.ndarray, value: np.ndarray, label: float) -> None:
        """One example; a bucket that both vectors hit counts twice."""
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
        g = (p - label) * value
        old = self.n[at]
        new = old + g * g
        np.add.at(self.z, at, g - (np.sqrt(new) - np.sqrt(old)) / ALPHA * w)
        np.add.at(self.n, at, g * g)


class Model:
    """Weights of the buckets. ``constant`` scores all texts alike, where there was nothing to learn from."""

    def __init__(self, weights: np.ndarray | None = None, constant: float = 0.5):
        self.weights, self.constant = weights, constant

    def scores(self, texts: list[str], words: Words) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.constant)
        dots = []
        for t in texts:
            at, value = vector(t, words)
            dots.append(float(self.weights[at] @ value))
        return 1 / (1 + np.exp(-np.clip(np.array(dots, dtype=float), -35, 35)))


def _sample(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    """(doc_id, label, text) of the labelled rows to learn from, one a document: a repeated id takes its largest label and its
    first text. ``fit_rows`` bounds them; the labels are chosen first, so only their texts are gathered."""
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").select(F.col("doc_id").cast("long"), (F.col("quality") > 0).cast("int").alias("label"))
    known = known.filter(~held_out(parts=PARTS, part=PART)).groupBy("doc_id").agg(F.max("label").alias("label"))
    text = docs.select(F.col("`doc_id`").cast("long").alias("id"), whole_text("`text`").alias("text"))
    chosen = known.join(text.select("id").distinct(), F.col("doc_id") == F.col("id"), "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    chosen = written(chosen, "quality-labels")  # at most fit_rows rows of 12 bytes, so it may be broadcast
    return text.join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = Words()
    for b in batches:
        made = [vector(t, words) for t in b.column(2).to_pylist()]
        lists = [pa.array([m[k] for m in made], pa.list_(kind)) for k, kind in ((0, pa.int32()), (1, pa.float32()))]
        yield pa.record_batch([b.column(0), b.column(1), *lists], names=["doc_id", "label", "at", "value"])


def _trained(shared, turn: int):
    """Runs one shard, in an order that differs with the turn, from the common state; returns what it has touched."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        z, n = shared.value
        own, seen = Leader(z.copy(), n.copy()), np.zeros(BUCKETS, dtype=bool)
        rows = rows.sort_values("doc_id", ignore_index=True)
        for i in np.random.default_rng(turn).permutation(len(rows)).tolist():
            at = rows["at"][i]
            own.update(at, rows["value"][i].astype(float), float(rows["label"][i]))
            seen[at] = True
        hit = np.flatnonzero(seen)
        return pd.DataFrame({"bucket": hit.astype(np.int32), "z": own.z[hit] - z[hit], "n": own.n[hit] - n[hit]})

    return run


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Learns from rows of ``docs`` that have a label and whose crc32(doc_id as text) mod 3 is not 1.

    Without labels of both kinds the model scores all texts by the share of labels 1 (0.5 without labels). State and weights
    are one number a bucket, so what reaches the driver is bounded by BUCKETS.
    """
    spark = docs.sparkSession
    sample = written(_sample(docs, labels, fit_rows).mapInArrow(_vectors, "doc_id long, label int, at array<int>, value array<float>"), "quality-sample")
    rows, good = sample.agg(F.count("*"), F.sum("label")).first()
    if not rows or good in (0, rows):
        return Model(constant=good / rows if rows else 0.5)
    shards = -(-rows // SHARD_ROWS)
    dealt = sample.withColumn("shard", F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(shards)))
    z, n = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast((z, n))
        moved = dealt.groupBy("shard").applyInPandas(_trained(shared, turn), "bucket int, z double, n double")
        moved = moved.groupBy("bucket").agg(F.sum("z").alias("z"), F.sum("n").alias("n")).toArrow()  # at most BUCKETS rows
        at = moved.column("bucket").to_numpy()
        z[at] += moved.column("z").to_numpy() / shards
        n[at] += moved.column("n").to_numpy() / shards
        shared.destroy()
    return Model(np.round(Leader(z, n).weights(), 9))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Null texts are scored as empty ones, which have the constant term alone; null ids are never held out; repeated rows come
    out as often as they come in, with equal scores; an empty table gives no rows; other columns, whatever their names, are not
    read. A very long text is scored whole and costs memory by its length. A score of exactly 0.5 is predicted 1.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            s = shared.value.scores(b.column(2).to_pylist(), words)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(s, pa.float64())], names=["doc_id", "held_out", "score"])

    frame = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), held_out("`doc_id`", PARTS, PART).alias("held_out"), whole_text("`text`").alias("text"))
    out = frame.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
