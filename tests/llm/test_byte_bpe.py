import hashlib
import random

import pytest
import tiktoken

from tessera.llm import byte_bpe

PATH, PATTERN = byte_bpe.public_ranks()


@pytest.fixture(scope="module")
def both():
    ranks = byte_bpe.read_ranks(PATH)
    return byte_bpe.Codec(ranks, PATTERN, memo=50), tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(3)
    fixed = ["", " ", "  ", "a", " a", "a ", "a  b", "don't 'll  \n\n x", "é ǘ 漢字 🙂🙂", "\n a", "a \n", "a\n b", "<|endoftext|>", "x" * 5000, "ab" * 3000, "'s 's\t't", " x y z", "a\x1cb c"]
    pool = list("abcdeft'hsr nl  \n\t.,!?0123éß漢🙂 ")
    return fixed + ["".join(rng.choice(pool) for _ in range(rng.randint(1, 200))) for _ in range(800)]


def test_encodes_as_the_library(both):
    codec, library = both
    for t in texts():
        ids = codec.encode(t)
        assert list(memoryview(ids).cast("I")) == library.encode_ordinary(t), repr(t)
        assert codec.decode(ids) == t.encode()


def test_letters_and_digits_are_the_librarys(both):
    codec, library = both
    rng = random.Random(8)
    points = [c for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000]
    newer = [c for c in points if byte_bpe._NEWER.match(chr(c))]
    some = rng.sample(points, 30_000) + rng.sample(newer, 4000) + list(range(0x80, 0x3000)) + list(range(0xA000, 0xAC00))
    for c in some:
        t = f"a{chr(c)}b 1{chr(c)}'d {chr(c)}  {chr(rng.choice(some))}"
        assert list(memoryview(codec.encode(t)).cast("I")) == library.encode_ordinary(t), ascii(t)
        assert codec.decode(codec.encode(t)) == t.encode()


def test_perfect_hash_is_minimal_and_rejects_strangers(both):
    table = both[0].table
    assert table.n == len(table.keys) == len(set(table.keys)) == 50256
    assert all(table.get(k) == v for k, v in zip(table.keys[::7], table.values[::7], strict=True))
    assert table.get(b"no such entry at all") is None and byte_bpe.PerfectHash([], []).get(b"x") is None


def test_rows(spark, both):
    rows = [(1, "hello world", 5), (1, "hello world", 5), (None, None, 1), (2, "", None)]
    got = byte_bpe.digests(spark.createDataFrame(rows, "doc_id long, text string, ids int"), PATH, PATTERN).collect()
    want = hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in both[1].encode_ordinary("hello world"))).hexdigest()
    assert [(r.doc_id, r.n_tokens) for r in got] == [(1, 2), (1, 2), (None, 0), (2, 0)]
    assert got[0].ids_sha256 == got[1].ids_sha256 == want and got[0].decoded_sha256 == hashlib.sha256(b"hello world").hexdigest()
    assert got[2].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert byte_bpe.encoded(spark.createDataFrame(rows, "doc_id long, text string, ids int"), PATH, PATTERN).filter("decoded = cast('hello world' as binary)").count() == 2
    assert byte_bpe.digests(spark.createDataFrame([], "doc_id long, text string"), PATH, PATTERN).collect() == []
