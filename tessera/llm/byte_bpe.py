"""Byte-level BPE encoding and decoding by a public rank file.

Two tiers: a minimal perfect hash over the vocabulary resolves pre-tokens that are whole entries; the others are merged with
a heap of adjacent pairs over linked bytes. A bounded memo keeps what spans of a text between single spaces and matches of the pattern encode to.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import whole_text

#: Spans that a task's memo holds before it is emptied.
MEMO = 1_000_000
#: What the pattern engine used here takes as letters or digits, and the library's, of Unicode 16, doesn't.
NEWER = (
    "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A "
    "11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 "
    "18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED "
    "1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
_NEWER = regex.compile("[" + "".join("-".join(f"\\U{x:0>8}" for x in r.split("-")) for r in NEWER.split()) + "]")


class PerfectHash:
    """Minimal perfect hash by hash-and-displace: n keys in n slots and a displacement for about two keys.

    The largest buckets are placed first; a bucket of one key names its slot outright. The slots hold the keys, so a lookup
    ends with one comparison of bytes.
    """

    def __init__(self, keys: list[bytes], values: list[int], load: int = 2):
        n = len(keys)
        self.n, self.buckets = n, max(1, -(-n // load))
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        if len(set(hashes)) < n:
            raise ValueError("repeated key or colliding 64-bit hashes")
        self.shift, own = [0] * self.buckets, [[] for _ in range(self.buckets)]
        for i, h in enumerate(hashes):
            own[h % self.buckets].append(i)
        back: list[int | None] = [None] * n
        for b in sorted(range(self.buckets), key=lambda b: -len(own[b])):
            if len(own[b]) <= 1:
                break
            d = 0
            while True:
                at = [self._slot(hashes[i], d) for i in own[b]]
                if len(set(at)) == len(at) and all(back[a] is None for a in at):
                    break
                d += 1
            self.shift[b] = d
            for a, i in zip(at, own[b], strict=True):
                back[a] = i
        free = (a for a in range(n) if back[a] is None)
        for b in range(self.buckets):
            if len(own[b]) == 1:
                a = next(free)
                back[a], self.shift[b] = own[b][0], -1 - a
        self.keys, self.values = [keys[i] for i in back], [values[i] for i in back]

    def _slot(self, h: int, d: int) -> int:
        return (((h ^ d * 0x9E3779B97F4A7C15) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF) >> 32) % self.n

    def get(self, key: bytes) -> int | None:
        if not self.n:
            return None
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        at = self._slot(h, d) if d >= 0 else -1 - d
        return self.values[at] if self.keys[at] == key else None


class Codec:
    """Encoder and decoder for one rank file; ``ranks`` maps byte strings to ids and has all single bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = MEMO):
        self.table = PerfectHash(list(ranks), list(ranks.values()))
        self.ranks = ranks  # of the pairs that merge
        self.pattern = regex.compile(pattern)
        self.match = self.pattern.findall
        self.words = [b""] * (max(ranks.values()) + 1)
        for k, v in ranks.items():
            self.words[v] = k
        self.sizes = list(map(len, self.words))
        self.memo, self.bare, self.limit = {}, {}, memo

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token that is no entry: the pair with the least rank, then the first, merges until none can.

        Symbols are linked by position: ``end[i]`` is where the symbol at i ends and the next one starts (0: merged away),
        ``prev`` the start of the one before. A heap entry is a rank and a position; it is stale unless the two symbols
        there now span as many bytes as the rank's entry.
        """
        n, get, size, push, pop = len(piece), self.ranks.get, self.sizes, heapq.heappush, heapq.heappop
        low = n.bit_length()
        mask = (1 << low) - 1
        end, prev = list(range(1, n + 1)), list(range(-1, n))
        heap = [r << low | i for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            x = pop(heap)
            i = x & mask
            j = end[i]
            if not j or j == n:
                continue
            stop = end[j]
            if stop - i != size[x >> low]:
                continue
            end[i], end[j], prev[stop] = stop, 0, i
            if stop < n and (r := get(piece[i : end[stop]])) is not None:
                push(heap, r << low | i)
            if i and (r := get(piece[(h := prev[i]) : stop])) is not None:
                push(heap, r << low | h)
        out, i = [], 0
        while i < n:
            out.append(get(piece[i : end[i]]))
            i = end[i]
        return out

    def _token(self, token: str) -> bytes:
        """A match of the pattern: the perfect hash, else merges. Remembered apart from the span it stands in."""
        spaced = token[0] == " " and len(token) > 1
        memo, key = (self.memo, token[1:]) if spaced else (self.bare, token)
        got = memo.get(key)
        if got is None:
            piece = token.encode("utf-8", "surrogatepass")
            whole = self.table.get(piece)
            if whole is None:
                ids = self.merge(piece)
                got = struct.pack(f"<{len(ids)}I", *ids)
            else:
                got = whole.to_bytes(4, "little")
            self._keep(memo, key, got)
        return got

    def _keep(self, memo: dict[str, bytes], key: str, value: bytes) -> None:
        if len(key) < 128:
            if len(memo) >= self.limit:
                memo.clear()
            memo[key] = value

    def _whole(self, text: str) -> bytes:
        return b"".join(map(self._token, self.match(text)))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers.

        Where every space has other characters on both sides, no match of the pattern crosses into the next span that starts
        with a space, so spans encode on their own; other texts are matched whole.
        """
        if not text.isascii() and _NEWER.search(text):  # matched with signs in place of what isn't a letter or digit to the library
            matches = self.pattern.finditer(_NEWER.sub("\ufffd", text))
            return b"".join([self._token(text[m.start() : m.end()]) for m in matches])
        first, *rest = text.split(" ")
        if first[-1:].isspace():
            return self._whole(text)
        memo = self.memo
        out = list(map(memo.get, rest))
        if None in out:
            for i, s in enumerate(rest):
                if out[i] is None:
                    if s.isalpha():  # one match, with its space
                        out[i] = self._token(" " + s)
                        continue
                    if not s or s[0].isspace() or s[-1].isspace():
                        return self._whole(text)
                    tokens = self.match(" " + s)
                    out[i] = got = b"".join(map(self._token, tokens))
                    if len(tokens) == 2:
                        self._keep(memo, s, got)
        return self._whole(first) + b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.words.__getitem__, memoryview(np.frombuffer(ids, dtype="<u4")).tolist()))


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the bytes, a space and the rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def encoded(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids binary, decoded binary) for every row; null texts are empty.

    The vocabulary is read once by the driver and broadcast: its size is the file's, whatever the documents.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Codec(read_ranks(ranks_path), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value
        for b in batches:
            ids = [codec.encode(t) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(ids, pa.binary()), pa.array([codec.decode(x) for x in ids], pa.binary())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(run, "doc_id long, ids binary, decoded binary")


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, decoded_equal), one row for every row of ``docs``.

    Encodes, then decodes the ids. Null texts are empty, null ids stay null; repeated rows come out as often as they come in,
    with equal values; an empty table gives no rows; other columns, whatever their names, are not read. Works batch by batch, so a very long text costs memory in proportion to its own length.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Codec(read_ranks(ranks_path), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value
        for b in batches:
            n, a, d, same = [], [], [], []
            for t in b.column(1).to_pylist():
                ids = codec.encode(t)
                back = codec.decode(ids)
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                d.append(hashlib.sha256(back).hexdigest())
                same.append(back == t.encode("utf-8", "surrogatepass"))
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string()), pa.array(same, pa.bool_())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "decoded_equal"])

    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, decoded_equal boolean")


def public_ranks(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    """Path of a public rank file and its pattern."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN
