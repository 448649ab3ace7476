"""Toxicity scores: gradient-boosted trees over dense features of a text, calibrated by isotonic regression.

Features: densities of a lexicon learned from labelled rows (words and word beginnings that tell toxic texts from others),
second-person words near lexicon hits, capitals, punctuation, and signs of obfuscated spelling.
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessera.llm.common import held_out, whole_text, written

#: Labelled rows that lexicon and trees are fitted on at most; chosen by digest of the id, so evenly over the table.
FIT_ROWS = 20_000
#: Lexicon entries at most; the toxic texts that an entry must be in; its least log odds.
LEXICON, MIN_TEXTS, MIN_WEIGHT = 4096, 3, 1.2
#: An entry in a lesser share of the toxic texts, as those of a minority language are, must be in toxic texts more often than
#: a word without meaning is with probability exp(-EVIDENCE) (Chernoff bound).
COMMON_SHARE, EVIDENCE = 0.02, 8.0
#: Lengths of the word beginnings that are tried as entries besides whole words.
STEMS = (4, 5, 6, 7)
#: Parts of the labelled rows, for lexica and trees that haven't seen a part.
FOLDS = 4
#: Weight from which an entry alone says much.
STRONG = 4.0
#: Second-person words of English, German, French and Spanish.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deinen deiner ihr euch euer tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros vuestro".split()
)
#: Words to either side of a hit in which a second-person word counts as near.
NEAR = 5
#: Characters that stand for letters in disguised spelling.
DISGUISES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"})

_WORD = re.compile(r"[^\W\d_]+")
_MIXED = re.compile(r"(?<![^\W\d_])[^\W\d_]++[0-9@$!|*]++[^\W\d_]++")
_SPACED = re.compile(r"(?:\b[^\W\d_][ .\-*_]){3,}[^\W\d_]\b")
_SHOUTED = re.compile(r"(?<![^\W\d_])[A-Z]{3,}+(?![^\W\d_])")

FEATURES = (
    "hits", "hit_density", "strong_hits", "strong_density", "stem_repeats", "stem_density", "entries", "weight_max", "weight_mean", "disguised_hits", "near_second_person", "second_person", "capitals", "shouted",
    "marks", "punctuation", "drawn_out", "mixed_spelling", "spaced_out", "log_words", "word_length",
)


def entries_of(text: str) -> set[str]:
    """Candidate lexicon entries: the lower-case words, and beginnings marked by a trailing hyphen."""
    words = set(_WORD.findall(text.lower()))
    return words | {w[:k] + "-" for w in words for k in STEMS if len(w) >= k}


class Lexicon(dict):
    """Weight of every word asked for: that of its best entry, remembered within bounds."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        get = self.weights.get
        got = max([get(word, 0.0), *(get(word[:k] + "-", 0.0) for k in STEMS if len(word) >= k)])
        if len(self) > 500_000:
            self.clear()
        if len(word) < 64:
            self[word] = got
        return got

    def __reduce__(self):
        return Lexicon, (self.weights,)

    def stem(self, word: str) -> str:
        """The shortest entry that the word begins with, or the word."""
        return next((word[:k] for k in STEMS if word[:k] + "-" in self.weights), word)


_CAPITAL, _LETTER, _PUNCT, _SYMBOL = (np.array([chr(c) in x for c in range(128)] + [False] * 128) for x in (string.ascii_uppercase, string.ascii_letters, string.punctuation, string.digits + "@$!|*"))


def features(text: str, lexicon: Lexicon) -> list[float]:
    """The values of FEATURES; all zero for a text without words or signs. Capitals, drawn-out letters and punctuation are
    those of ASCII."""
    low = _WORD.findall(text.lower())
    n, chars = max(1, len(low)), max(1, len(text))
    weights = np.fromiter(map(lexicon.__getitem__, low), dtype=np.float64, count=len(low))
    at = np.flatnonzero(weights > 0)
    hit = weights[at]
    hits = [low[i] for i in at.tolist()]
    you = np.array([i for i, w in enumerate(low) if w in SECOND_PERSON], dtype=np.int64)
    k = np.searchsorted(you, at - NEAR)
    near = int((you[np.minimum(k, len(you) - 1)][k < len(you)] <= at[k < len(you)] + NEAR).sum()) if len(you) else 0
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    count = np.bincount(raw, minlength=256)
    capital, letter = _CAPITAL[raw], _LETTER[raw]
    shouted = len(_SHOUTED.findall(text)) if (capital[2:] & capital[1:-1] & capital[:-2]).any() else 0
    third = letter[2:] & (raw[2:] == raw[1:-1]) & (raw[1:-1] == raw[:-2])
    drawn = int(third.sum() - (third[1:] & third[:-1]).sum())
    mixed = _MIXED.findall(text) if count[_SYMBOL].any() else []
    disguised = sum(lexicon[w.lower().translate(DISGUISES).replace("*", "")] > 0 for w in mixed)
    spaced = len(_SPACED.findall(text)) if sum(map((1).__eq__, map(len, low))) > 3 else 0
    strong = int((hit >= STRONG).sum())
    repeats = max(Counter(map(lexicon.stem, hits)).values(), default=0)
    letters = sum(map(len, low))
    return [
        len(at), len(at) / n, strong, strong / n, repeats, repeats / n, len(set(hits)), float(hit.max(initial=0)), float(hit.sum()) / n, disguised, near / n, len(you) / n,
        int(count[_CAPITAL].sum()) / max(1, letters), shouted / n, int(count[33] + count[63]) / chars, int(count[_PUNCT].sum()) / chars, drawn / n, len(mixed) / n, spaced / n,
        math.log1p(len(low)), letters / n,
    ]


class Trees:
    """Logistic gradient boosting with shallow trees over quantile bins."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.base, self.trees = 0.0, []

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        share = min(max(float(y.mean()), 1e-6), 1 - 1e-6)
        self.base = math.log(share / (1 - share))
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        self.edges = [np.unique(np.concatenate((e, [c.min() + 1e-12] if len(c) else []))) for e, c in zip(self.edges, x.T, strict=True)]
        b, raw = self._bin(x), np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            grad, curve = y - p, p * (1 - p)
            tree, node = [], np.zeros(len(y), dtype=np.int64)  # tree: feature (-1: leaf), bin, value; children of k at 2k+1, 2k+2
            for k in range(2 ** (self.depth + 1) - 1):
                rows = np.flatnonzero(node == k)
                g, h = grad[rows].sum(), curve[rows].sum()
                best = (1e-9, -1, 0)
                if k < 2**self.depth - 1 and len(rows) > 1:
                    for f in range(x.shape[1]):
                        size = len(self.edges[f]) + 1
                        gs, hs = (np.cumsum(np.bincount(b[rows, f], weights=w[rows], minlength=size))[:-1] for w in (grad, curve))
                        gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                        gain[(hs < self.least / 4) | (h - hs < self.least / 4)] = 0
                        if len(gain) and gain.max() > best[0]:
                            best = (float(gain.max()), f, int(gain.argmax()))
                tree.append((best[1], best[2], self.rate * g / (h + 1)))
                if best[1] >= 0:
                    node[rows] = 2 * k + 1 + (b[rows, best[1]] > best[2])
                else:
                    raw[rows] += tree[-1][2]
                    node[rows] = -1
            self.trees.append(tree)
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if not self.trees or not len(x):
            return out
        b = self._bin(x)
        for tree in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            feature, cut, value = (np.array(c) for c in zip(*tree, strict=True))
            for _ in range(self.depth):
                f = feature[node]
                inner = f >= 0
                node[inner] = 2 * node[inner] + 1 + (b[np.flatnonzero(inner), f[inner]] > cut[node[inner]])
            out += value[node]
        return out


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of y on raw by pooling adjacent violators; equal raw values are pooled first."""
    at, back = np.unique(raw, return_inverse=True)
    weight, total = np.bincount(back).astype(float), np.bincount(back, weights=y)
    blocks: list[list[float]] = []  # weight, sum, first and last raw value
    for w, t, v in zip(weight.tolist(), total.tolist(), at.tolist(), strict=True):
        blocks.append([w, t, v, v])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w2, t2, _, last = blocks.pop()
            blocks[-1][0] += w2
            blocks[-1][1] += t2
            blocks[-1][3] = last
    x = [v for b in blocks for v in ((b[2], b[3]) if b[3] > b[2] else (b[2],))]
    z = [b[1] / b[0] for b in blocks for _ in ((0, 1) if b[3] > b[2] else (0,))]
    return np.array(x), np.array(z)


class Model:
    """Lexicon, trees and calibration. ``constant`` scores all texts alike, where there was nothing to learn from."""

    def __init__(self, lexicon: Lexicon, trees: Trees | None = None, knots=None, constant: float = 0.0):
        self.lexicon, self.trees, self.knots, self.constant = lexicon, trees, knots, constant

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.constant)
        x = np.array([features(t, self.lexicon) for t in texts], dtype=float).reshape(-1, len(FEATURES))
        return np.interp(self.trees.raw(x), *self.knots)


def _sample(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    """(doc_id, toxic, fold, text) of the labelled rows to learn from, one a document: a repeated id takes its largest label
    and its first text. ``fit_rows`` bounds them; the labels are chosen first, so only their texts are gathered."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").select(F.col("doc_id").cast("long"), (F.col("toxic") > 0).cast("int").alias("toxic")).filter(~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    text = docs.select(F.col("doc_id").cast("long").alias("id"), whole_text().alias("text"))
    chosen = known.join(text.select("id").distinct(), F.col("doc_id") == F.col("id"), "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    chosen = written(chosen, "toxicity-labels")  # at most fit_rows rows of 12 bytes, so it may be broadcast
    found = text.join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return written(found.select("doc_id", "toxic", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold"), "text"), "toxicity-sample")


def learn_lexicons(sample: DataFrame, size: int = LEXICON) -> list[dict[str, float]]:
    """Entries with their weights (log odds, smoothed, of being in a toxic text against another one): first from all rows,
    then for each fold from the rows outside it."""
    folds = range(FOLDS)
    texts = {(r.fold, r.toxic): r.n for r in sample.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect()}  # at most two a fold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count: dict[str, list[int]] = {}
            for toxic, fold, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                for e in entries_of(t):
                    count.setdefault(e, [0] * 2 * FOLDS)[2 * fold + toxic] += 1
            yield pa.record_batch([pa.array(list(count), pa.string()), *(pa.array([c[k] for c in count.values()], pa.int64()) for k in range(2 * FOLDS))], names=["entry", *names])

    names = [f"{kind}{k}" for k in folds for kind in ("clean", "toxic")]
    counts = sample.select("toxic", "fold", "text").mapInArrow(run, "entry string, " + ", ".join(f"{n} long" for n in names)).groupBy("entry").agg(*[F.sum(n).alias(n) for n in names])
    counts = written(counts.filter(sum(F.col(f"toxic{k}") for k in folds) >= MIN_TEXTS), "lexicon-counts")
    out = []
    for left in (None, *folds):
        used = [k for k in folds if k != left]
        clean, toxic = (sum(F.col(f"{kind}{k}") for k in used) for kind in ("clean", "toxic"))
        neg, pos = (float(sum(texts.get((k, y), 0) for k in used)) for y in (0, 1))
        odds = F.log((toxic + 0.1) / (pos + 0.2)) - F.log((clean + 0.1) / (neg + 0.2))
        share = toxic / (toxic + clean)
        rest = F.when(clean > 0, clean * F.log((1 - share) / F.lit(neg / (pos + neg) if neg else 1.0))).otherwise(0.0)
        evidence = toxic * F.log(share / F.lit(pos / (pos + neg) if pos else 1.0)) + rest
        best = counts.filter((toxic >= MIN_TEXTS) & ((toxic >= COMMON_SHARE * pos) | (evidence >= EVIDENCE))).select("entry", F.round(odds, 6).alias("weight"), F.round(toxic * odds, 6).alias("gain"))
        best = best.filter(F.col("weight") > MIN_WEIGHT).orderBy(F.col("gain").desc(), "entry").limit(size)
        out.append({r.entry: r.weight for r in best.collect()})
    return out


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Learns from rows of ``docs`` that have a label and whose crc32(doc_id as text) mod 5 is not 0.

    The trees see each row by the lexicon that its fold had no part in, and calibration its score by trees that its fold had
    no part in, so neither rests on hits that only these very rows have. Without labels of both kinds the model scores all
    texts by the share of toxic labels (0 without labels).
    """
    sample = _sample(docs, labels, fit_rows)
    full, *others = (Lexicon(w) for w in learn_lexicons(sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pa.array([features(t, others[k]) for k, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)], pa.list_(pa.float64()))
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), x], names=["doc_id", "toxic", "fold", "x"])

    rows = sample.mapInArrow(run, "doc_id long, toxic int, fold int, x array<double>").collect()  # at most fit_rows
    rows.sort(key=lambda r: r.doc_id)
    y, fold = np.array([r.toxic for r in rows], dtype=float), np.array([r.fold for r in rows])
    x = np.array([r.x for r in rows], dtype=float).reshape(-1, len(FEATURES))
    if len(set(y.tolist())) < 2:
        return Model(full, constant=float(y.mean()) if len(y) else 0.0)
    raw = np.zeros(len(y))
    for k in range(FOLDS):
        if (own := fold == k).any():
            rest = ~own if not own.all() else own
            raw[own] = Trees().fit(x[rest], y[rest]).raw(x[own])
    return Model(full, Trees().fit(x, y), isotonic(raw, y))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Null texts are scored as empty ones, null ids are never held out; repeated rows come out as often as they come in, with
    equal scores; an empty table gives no rows; other columns, whatever their names, are not read. A very long text is scored
    whole and costs memory by its length. A score of exactly 0.5 is predicted 1.
    """
    frame = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), held_out("`doc_id`").alias("held_out"), whole_text("`text`").alias("text"))
    out = frame.mapInArrow(_scorer(docs, model), "doc_id long, held_out boolean, score double")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _scorer(docs: DataFrame, model: Model):
    """Replaces the last column of each batch, the text, by its score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = shared.value.scores(b.column(b.num_columns - 1).to_pylist())
            yield pa.record_batch([*b.columns[:-1], pa.array(s, pa.float64())], names=[*b.schema.names[:-1], "score"])

    return run


def accepted(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, their columns unchanged, whatever their names. Nulls, repeated rows,
    long texts and empty tables as in ``scored``; without labels of both kinds no row is rejected unless all labels are toxic."""
    frame = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), whole_text("`text`").alias("text"))
    kind = StructType([frame.schema["row"], StructField("score", DoubleType())])
    kept = frame.mapInArrow(_scorer(docs, fit(docs, labels, fit_rows)), kind).filter("score < 0.5")
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
