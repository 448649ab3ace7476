"""Token ids in wavelet matrices: one for each shard, compressed as one file.

A wavelet matrix holds the ids as one bit plane for each binary digit, each ordered by the digits above it. With ranks at
superblocks it gives the id at a position, the count of an id in a range, and the position of its k-th occurrence. Planes are
compressed in blocks and ranks lie beside them, so these lookups inflate only the blocks that they touch.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import new_path, whole_text

#: Ids a shard holds, about; a longer document has a shard of its own.
SHARD_TOKENS = 1 << 20
#: Bits between two stored ranks.
SUPER = 512
#: Bytes of a bit plane that are compressed together; a multiple of a superblock's.
BLOCK = 1 << 14
#: The id that ends every document.
END = 1
#: Chunks of text that a worker's memo holds, about, before it is emptied.
MEMO = 1_000_000
#: Bytes of text that are encoded at a time, about; a longer text is encoded alone.
SLICE = 1 << 24
#: New words that the library is asked for at a time.
ASKED = 1 << 13

#: The byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: b if b in _PLAIN else 256 + sum(x not in _PLAIN for x in range(b)) for b in range(256)}
#: Letters from A to U+024F, all assigned and composed since Unicode 5.
_LETTER = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]"
_LATIN = re.compile(f"{_LETTER}+")
#: Where a mark other than the apostrophe follows such a letter, one match of the pattern ends and another begins.
_MARKED = f"({_LETTER})([!-&(-/:-@\\[-`{{-~])"
#: What texts hold that aren't cut into chunks: special tokens may hold white space, and these separators are white space
#: to str.split and Arrow, not to the library.
_UNCUT = r"<\||[\x1c-\x1f]"
_MAGIC = b"TWM2"
_COUNT = np.array([bin(x).count("1") for x in range(256)], dtype=np.uint16)


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Plane:
    """One bit plane, held as compressed blocks of ``BLOCK`` bytes that are inflated when a lookup first touches them."""

    __slots__ = ("_blocks", "_frames", "size")

    def __init__(self, size: int, frames: list, blocks: dict[int, np.ndarray] | None = None):
        self.size, self._frames, self._blocks = size, frames, blocks if blocks is not None else {}

    @classmethod
    def of(cls, bits: np.ndarray) -> _Plane:
        return cls(len(bits), [None] * -(-len(bits) // BLOCK), {k: bits[k * BLOCK : (k + 1) * BLOCK] for k in range(-(-len(bits) // BLOCK))})

    def block(self, k: int) -> np.ndarray:
        if k not in self._blocks:
            self._blocks[k] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self._frames[k]), dtype=np.uint8)
        return self._blocks[k]

    def byte(self, i: int) -> int:
        return int(self.block(i // BLOCK)[i % BLOCK])

    def span(self, lo: int, hi: int) -> np.ndarray:
        """Bytes [lo, hi), which lie in one block since superblocks do."""
        return self.block(lo // BLOCK)[lo % BLOCK : lo % BLOCK + hi - lo] if lo < min(hi, self.size) else np.empty(0, dtype=np.uint8)

    def whole(self) -> np.ndarray:
        return np.concatenate([self.block(k) for k in range(len(self._frames))]) if self._frames else np.empty(0, dtype=np.uint8)

    @property
    def inflated(self) -> int:
        return len(self._blocks)


class WaveletMatrix:
    """Sequence of unsigned integers below 2 ** 32."""

    def __init__(self, n: int, planes: list[_Plane], zeros: list[int], ranks: list[np.ndarray]):
        self.n, self.planes, self.zeros, self.ranks = n, planes, zeros, ranks  # ranks: ones before each superblock, by plane

    @staticmethod
    def _count(plane: np.ndarray) -> np.ndarray:
        padded = np.zeros(-(-max(1, len(plane)) // (SUPER // 8)) * (SUPER // 8), dtype=np.uint8)
        padded[: len(plane)] = plane
        ones = np.bitwise_count(padded.view(np.uint64)).reshape(-1, SUPER // 64).sum(1, dtype=np.uint32)
        return np.concatenate((np.zeros(1, dtype=np.uint32), np.cumsum(ones, dtype=np.uint32)))

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        top = int(ids.max(initial=0))
        now = ids.astype(np.uint16 if top < 1 << 16 else np.uint32)
        planes, zeros, ranks = [], [], []
        for level in range(max(1, top.bit_length()) - 1, -1, -1):
            ones = (now & now.dtype.type(1 << level)) != 0  # places are gathered faster than masked elements
            bits = np.packbits(ones, bitorder="little")
            planes.append(_Plane.of(bits))
            ranks.append(cls._count(bits))
            low, high = now[np.flatnonzero(~ones)], now[np.flatnonzero(ones)]
            zeros.append(len(low))
            now = np.concatenate((low, high))
        return cls(len(ids), planes, zeros, ranks)

    def to_bytes(self) -> bytes:
        """Head, zeros, ranks, lengths of the compressed blocks, then these: a lookup inflates the blocks that it needs."""
        squeeze = zstandard.ZstdCompressor(level=1, write_checksum=True).compress
        frames = [squeeze(p.block(k).tobytes()) for p in self.planes for k in range(-(-p.size // BLOCK))]
        head = _MAGIC + struct.pack("<QB", self.n, len(self.planes)) + struct.pack(f"<{len(self.zeros)}Q", *self.zeros)
        ranks = b"".join(r.astype("<u4").tobytes() for r in self.ranks)
        return b"".join((head, ranks, struct.pack(f"<{len(frames)}I", *map(len, frames)), *frames))

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        raw = memoryview(data)
        if bytes(raw[:4]) != _MAGIC:
            raise ValueError("no wavelet matrix")
        n, levels = struct.unpack_from("<QB", raw, 4)
        zeros, size, at = list(struct.unpack_from(f"<{levels}Q", raw, 13)), -(-n // 8), 13 + 8 * levels
        supers, blocks = -(-max(1, size) // (SUPER // 8)) + 1, -(-size // BLOCK)
        ranks = [np.frombuffer(raw, dtype="<u4", count=supers, offset=at + k * supers * 4) for k in range(levels)]
        at += levels * supers * 4
        lengths = struct.unpack_from(f"<{levels * blocks}I", raw, at)
        at += 4 * levels * blocks
        frames = []
        for length in lengths:
            frames.append(raw[at : at + length])
            at += length
        if at != len(raw):
            raise ValueError("wavelet matrix is cut off")
        return cls(n, [_Plane(size, frames[k * blocks : (k + 1) * blocks]) for k in range(levels)], zeros, ranks)

    def to_array(self) -> np.ndarray:
        """All ids, from the last plane up: each plane says which of the next one's two parts an element comes from."""
        levels = len(self.planes)
        now = np.zeros(self.n, dtype=np.uint16 if levels <= 16 else np.uint32)
        for k in range(levels - 1, -1, -1):
            ones = np.unpackbits(self.planes[k].whole(), count=self.n, bitorder="little").view(bool)
            up = np.empty_like(now)
            up[np.flatnonzero(~ones)] = now[: self.zeros[k]]
            up[np.flatnonzero(ones)] = now[self.zeros[k] :] | now.dtype.type(1 << (levels - 1 - k))
            now = up
        return now

    def _ones(self, k: int, i: int) -> int:
        """Ones of plane k before position i."""
        block = i // SUPER
        ones = int(self.ranks[k][block]) + int(_COUNT[self.planes[k].span(block * (SUPER // 8), i // 8)].sum())
        return ones + (self.planes[k].byte(i // 8) & ((1 << i % 8) - 1)).bit_count() if i % 8 else ones

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for k, z in enumerate(self.zeros):
            bit = self.planes[k].byte(i // 8) >> i % 8 & 1
            out = out << 1 | bit
            i = z + self._ones(k, i) if bit else i - self._ones(k, i)
        return out

    def _range(self, value: int, lo: int, hi: int) -> tuple[int, int]:
        """Where the occurrences of ``value`` in positions [lo, hi) stand below the last plane."""
        levels = len(self.zeros)
        if value < 0 or value >> levels:
            return 0, 0
        for k, z in enumerate(self.zeros):
            a, b = self._ones(k, lo), self._ones(k, hi)
            lo, hi = (z + a, z + b) if value >> (levels - 1 - k) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, value: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of ``value`` in positions [lo, hi)."""
        a, b = self._range(value, max(0, lo), self.n if hi is None else min(hi, self.n))
        return max(0, b - a)

    def select(self, value: int, k: int) -> int:
        """Position of the k-th occurrence (from 0) of ``value``; -1 if there are fewer."""
        lo, hi = self._range(value, 0, self.n)
        if not 0 <= k < hi - lo:
            return -1
        i, levels = lo + k, len(self.zeros)
        for j in range(levels - 1, -1, -1):
            i = self._select_bit(j, value >> (levels - 1 - j) & 1, i - self.zeros[j] if value >> (levels - 1 - j) & 1 else i)
        return i

    def _select_bit(self, k: int, bit: int, nth: int) -> int:
        """Position of the nth one (or zero) of plane k: binary search over superblocks, then within one."""
        ranks = self.ranks[k].astype(np.int64)
        before = ranks if bit else np.arange(len(ranks), dtype=np.int64) * SUPER - ranks
        block = int(np.searchsorted(before, nth, "right")) - 1
        bits = np.unpackbits(self.planes[k].span(block * (SUPER // 8), (block + 1) * (SUPER // 8)), bitorder="little")
        return block * SUPER + int(np.flatnonzero(bits == bit)[nth - before[block]])

    def occurrences(self, value: int) -> list[int]:
        return [self.select(value, k) for k in range(self.count(value))]


class Encoder:
    """Ids of whole texts by a tokenizers file that drops white space: its matches never hold any, so the chunks between white
    space are encoded on their own, by the library, and remembered. What a chunk gives never depends on the chunks before it.
    Texts come as Arrow columns: Arrow cuts them and numbers their chunks, so Python meets each chunk of a column once."""

    def __init__(self, path: str, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.memo, self.limit = {}, memo
        self.model = Tokenizer(self.library.model)  # alone: words in bytes' characters, one a line
        self.model.pre_tokenizer = pre_tokenizers.Split("\n", "removed")
        vocab, suffix = self.library.get_vocab(), self.library.model.end_of_word_suffix
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)  # ids that end a word
        self.ends[[i for t, i in vocab.items() if suffix and t.endswith(suffix)]] = True

    def tokenize(self, words: str) -> list[int]:
        return self.model.encode_batch_fast([words], add_special_tokens=False)[0].ids

    def _ask(self, texts: list[str]) -> list[bytes]:
        return [_pack(e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Of lower-case words, many in one call: the ids that end a word say where each one's ids end."""
        own = [w if w.isascii() else w.encode().decode("latin-1").translate(_BYTE_CHARS) for w in words]
        ids = np.array(self.tokenize("\n".join(own)), dtype="<u4")
        ends = 4 * np.flatnonzero(self.ends[ids]) + 4
        if len(ends) != len(words):  # a vocabulary without words' ends
            return self._ask(words)
        raw, ends = ids.tobytes(), ends.tolist()
        return [raw[a:e] for a, e in zip([0, *ends], ends, strict=False)]

    def _learn(self, chunks: list[str]) -> None:
        """Remembers chunks. Those of Latin letters are one match of the pattern, whatever the Unicode version, and no normal
        form changes them: their lower-case bytes go straight to the library's model, once for all forms in other letters. All
        other chunks go through the library as they are."""
        memo, others, words, forms = self.memo, [], {}, {}
        for c in chunks:
            if (c.isalpha() if c.isascii() else _LATIN.fullmatch(c)):
                low = c.lower()
                if low not in memo:
                    words[low] = None
                if low != c:
                    forms[c] = low
            else:
                others.append(c)
        new = list(words)
        for at in range(0, len(new), ASKED):
            some = new[at : at + ASKED]
            memo.update(zip(some, self._words(some), strict=True))
        memo.update(zip(forms, map(memo.__getitem__, forms.values()), strict=True))
        memo.update(zip(others, self._ask(others), strict=True))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, as the library encodes each whole text, and how many each text has.

        Texts that hold ``_UNCUT`` are encoded whole. The memo is emptied between calls if it is full.
        """
        memo = self.memo
        if len(memo) > self.limit:
            memo.clear()
        memo[""] = b""  # white space at an end leaves an empty chunk
        uncut = pc.match_substring_regex(texts, _UNCUT)
        cut = pc.replace_substring_regex(pc.if_else(uncut, pa.scalar("", texts.type), texts), _MARKED, r"\1 \2")
        split = pc.utf8_split_whitespace(cut)
        chunks = split.flatten().dictionary_encode()
        names = chunks.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._learn([c for c in names if c not in memo])
        known = list(map(memo.__getitem__, names))
        starts = np.zeros(len(known) + 1, dtype=np.int32)
        np.cumsum(np.fromiter(map(len, known), dtype=np.int32, count=len(known)) // 4, out=starts[1:])
        got = pa.ListArray.from_arrays(pa.array(starts), pa.array(np.frombuffer(b"".join(known), dtype="<u4"))).take(chunks.indices)
        ids, at = got.flatten().to_numpy(), got.offsets.to_numpy()[split.offsets.to_numpy()]
        sizes = np.diff(at).astype(np.int64)
        which = np.flatnonzero(uncut.to_numpy(zero_copy_only=False))
        if len(which):  # these have no ids yet
            asked = [np.frombuffer(x, dtype="<u4") for x in self._ask(texts.take(pa.array(which)).to_pylist())]
            sizes[which] = list(map(len, asked))
            first, *others = np.split(ids, at[which])
            ids = np.concatenate([first, *(x for pair in zip(asked, others, strict=True) for x in pair)])
        return ids, sizes

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """``encode`` of each text, as little-endian unsigned 32-bit integers."""
        ids, sizes = self.encode(pa.array(texts, pa.string()))
        raw, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(sizes)).tolist()
        return [raw[a:e] for a, e in zip([0, *ends], ends, strict=False)]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch (doc_id, text) in slices of about ``SLICE`` bytes of text."""
    at = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(), dtype=np.int64) // SLICE
    cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), batch.num_rows]
    for a, e in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, e - a)


SHARD = "part int, seq int, n_tokens long, doc_ids array<long>, lengths array<long>, matrix binary"


def write_shards(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = END, shard_tokens: int = SHARD_TOKENS) -> None:
    """Writes the ids of every text, each followed by ``end_id``, in ascending doc_id order (null first; equal ids by the hash
    of their texts): rows (part, seq, n_tokens, doc_ids, lengths, matrix), ordered by part and seq.

    The texts are dealt by ranges of doc_id, so shards need no further shuffle; a task holds one shard at a time. Null texts
    are empty; every document has at least its end id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq = _encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        ids, docs_, lengths, total = [], [], [], 0

        def shard() -> pa.RecordBatch:
            matrix = WaveletMatrix.build(np.concatenate(ids))
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.record_batch([pa.array([x], t) for x, t in zip((part, seq, total, docs_, lengths, matrix.to_bytes()), kinds, strict=True)], names=["part", "seq", "n_tokens", "doc_ids", "lengths", "matrix"])

        for b in batches:
            for some in _slices(b):
                got, sizes = encoder.encode(some.column(1))
                got, at = np.insert(got, np.cumsum(sizes), end_id), 0
                for doc_id, size in zip(some.column(0).to_pylist(), (sizes + 1).tolist(), strict=True):
                    if docs_ and total + size > shard_tokens:
                        yield shard()
                        ids, docs_, lengths, total, seq = [], [], [], 0, seq + 1
                    ids.append(got[at : at + size])
                    docs_.append(doc_id)
                    lengths.append(size)
                    total += size
                    at += size
        if docs_:
            yield shard()

    text = whole_text()
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("th"))
    rows = rows.repartitionByRange("doc_id", "th").sortWithinPartitions("doc_id", "th").select("doc_id", "text")
    rows.mapInArrow(run, SHARD).write.option("compression", "none").parquet(path)


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One encoder for all tasks of a worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARD).parquet(path)


def index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the shards' bytes; start counts the ids of all documents
    before it. Sums over parts, then within a part, so no task reads all shards' rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, seq, docs_, lengths, matrix in zip(*(b.column(c).to_pylist() for c in ("part", "seq", "doc_ids", "lengths")), b.column("matrix"), strict=True):
                ids = WaveletMatrix.from_bytes(matrix.as_buffer()).to_array().astype("<u4")
                ends = np.cumsum(lengths)
                if len(ids) != ends[-1]:
                    raise ValueError("shard and its document lengths differ")
                starts = ends - lengths
                crcs = [zlib.crc32(ids[a:e]) for a, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(docs_)
                yield pa.record_batch([pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(docs_, pa.int64()), pa.array(starts), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())], names=["part", "seq", "doc_id", "local", "n_tokens", "ids_crc32"])

    shards = read_shards(spark, path)
    sizes = shards.select("part", "seq", "n_tokens")
    before = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    offsets = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))  # a row for each part
    offsets = sizes.select("part", "seq", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("shard_start")).join(offsets, "part").select(F.col("part").alias("p"), F.col("seq").alias("s"), (F.col("part_start") + F.col("shard_start")).alias("offset"))
    rows = shards.mapInArrow(run, "part int, seq int, doc_id long, local long, n_tokens long, ids_crc32 long")
    rows = rows.join(offsets, (F.col("part") == F.col("p")) & (F.col("seq") == F.col("s")))
    return rows.select("doc_id", (F.col("offset") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def occurrences(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """(id, doc_id, at): every occurrence of ``ids`` and its place in its document, by select queries on the shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for docs_, lengths, matrix in zip(b.column("doc_ids").to_pylist(), b.column("lengths").to_pylist(), b.column("matrix"), strict=True):
                w, ends = WaveletMatrix.from_bytes(matrix.as_buffer()), np.cumsum(lengths)
                for i in ids:
                    found = np.array(w.occurrences(i), dtype=np.int64)
                    which = np.searchsorted(ends, found, "right")
                    starts = (ends - lengths)[which]
                    yield pa.record_batch([pa.array([i] * len(found), pa.int64()), pa.array([docs_[k] for k in which], pa.int64()), pa.array(found - starts, pa.int64())], names=["id", "doc_id", "at"])

    return read_shards(spark, path).select("doc_ids", "lengths", "matrix").mapInArrow(run, "id long, doc_id long, at long")


def count_ids(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """(id, n): occurrences in all shards, by rank queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for matrix in b.column("matrix"):
                w = WaveletMatrix.from_bytes(matrix.as_buffer())
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array([w.count(i) for i in ids], pa.int64())], names=["id", "n"])

    return read_shards(spark, path).select("matrix").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def stored(docs: DataFrame, tokenizer_path: str, end_id: int = END, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Writes shards of ``docs`` in the shared folder and reads their index back.

    Null texts are empty, and every document has its end id; rows of equal doc_id, null first, come in the order of their
    texts' hashes, and equal rows, which come out as often as they come in, side by side. An empty table gives no rows; other
    columns, whatever their names, are not read. A very long text has a shard of its own and costs memory by its length."""
    path = new_path(docs.sparkSession, "token-shards")
    write_shards(docs, tokenizer_path, path, end_id, shard_tokens)
    return index(docs.sparkSession, path)


def public_tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
