import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tessera.llm import token_store
from tessera.llm.common import new_path

PATH = token_store.public_tokenizer()


@pytest.mark.parametrize(("n", "top"), [(0, 5), (1, 1), (7, 1), (513, 3), (5000, 49407), (3000, 2**31)])
def test_wavelet_matrix_against_a_list(n, top):
    rng = np.random.default_rng(n)
    ids = np.where(rng.random(n) < 0.3, rng.integers(0, min(top, 3) + 1, n), rng.integers(0, top + 1, n)).astype(np.uint32)
    w = token_store.WaveletMatrix.from_bytes(token_store.WaveletMatrix.build(ids).to_bytes())
    assert w.to_array().tolist() == ids.tolist()
    for i in rng.integers(0, max(1, n), 40).tolist() if n else []:
        assert w.access(i) == ids[i]
    for value in {0, 1, 2, top, top + 1, -1, *ids[:5].tolist()}:
        at = np.flatnonzero(ids == value).tolist()
        lo, hi = sorted(rng.integers(0, n + 1, 2).tolist())
        assert w.count(value) == len(at) and w.count(value, lo, hi) == sum(lo <= x < hi for x in at)
        assert [w.select(value, k) for k in range(min(len(at), 20))] == at[:20] and w.select(value, len(at)) == -1
    with pytest.raises(IndexError):
        w.access(n)


def test_encodes_as_the_library():
    rng = random.Random(4)
    library, own = Tokenizer.from_file(PATH), token_store.Encoder(PATH, memo=40)
    pool = list("abcdeTHEr'st  \n\t.,;:!?0123éÉßİΣς漢🙂́ \x1c\x85 ")
    texts = ["", " ", "Hello, World.", "don't we'll", "é x", "<|endoftext|> a", "a<|startoftext|>", "ΑΣ. ΑΣ", "İstanbul ﬁne \u0958a \u0958, ǅ", "word, " * 50, "A" * 3000] + ["".join(rng.choice(pool) for _ in range(rng.randint(1, 120))) for _ in range(600)]
    for at in range(0, len(texts), 7):
        for t, got in zip(texts[at : at + 7], own.encode_all(texts[at : at + 7]), strict=True):
            assert list(struct.unpack(f"<{len(got) // 4}I", got)) == library.encode(t, add_special_tokens=False).ids, repr(t)
    assert own.encode_all([]) == []


def test_no_chunk_depends_on_those_before_it():
    library, rng = Tokenizer.from_file(PATH), random.Random(9)
    want = lambda t: library.encode(t, add_special_tokens=False).ids
    for letter in "\u0958\u0f4d\ufb1d\u0344\u1e9e\u0130\u01c5\u00e9\u212b":
        for texts in ([letter, f"{letter},", f"a{letter}.", f"{letter}a"], [f"{letter},", letter, f"{letter}a", f"a{letter}."]):
            own = token_store.Encoder(PATH)
            for t in texts:
                got = own.encode_all([t])[0]
                assert list(struct.unpack(f"<{len(got) // 4}I", got)) == want(t), ascii(texts)
    own = token_store.Encoder(PATH)  # one memo for all
    assigned = [c for c in map(chr, range(0x20, 0x20000)) if not 0xD800 <= ord(c) < 0xE000]
    texts = ["".join(rng.choice(assigned) if rng.random() < 0.5 else rng.choice("aB .,'1") for _ in range(rng.randint(1, 6))) for _ in range(20000)]
    texts += [f"{c}{m}" for c in map(chr, range(0xC0, 0x250)) for m in ("", ".", "a,")]
    for t, got in zip(texts, own.encode_all(texts), strict=True):
        assert list(struct.unpack(f"<{len(got) // 4}I", got)) == want(t), ascii(t)


def test_a_word_is_tokenized_once_in_all_its_forms():
    """With or without a mark, in any letters; forms that lower-case beyond the Latin range, and these as chunks, included."""
    library, own, asked = Tokenizer.from_file(PATH), token_store.Encoder(PATH), []
    model = own.tokenize
    own.tokenize = lambda word: asked.append(word) or model(word)
    texts = ["treelike", "treelike, Treelike. \u00e9t\u00e9", "\u00c9T\u00c9; \u00e9t\u00e9: TREELIKE \u00c9t\u00e9.", "treelike;"]
    texts += [f(c) for c in map(chr, range(0xC0, 0x250)) for f in (str, str.lower, lambda c: f"a{c.upper()}, {c.lower()}.")]
    for t in texts:
        got = own.encode_all([t])[0]
        assert list(struct.unpack(f"<{len(got) // 4}I", got)) == library.encode(t, add_special_tokens=False).ids, ascii(t)
    assert len(asked) == len(set(asked)) and asked[0] == "treelike"


def test_a_chunk_is_looked_up_once_a_column():
    class Counted(dict):
        reads = 0

        def __getitem__(self, key):
            Counted.reads += 1
            return super().__getitem__(key)

    own, text = token_store.Encoder(PATH), "the sea the moon, " * 500
    own.memo = Counted()
    assert own.encode_all([text] * 20) == [token_store.Encoder(PATH)._ask([text])[0]] * 20
    assert Counted.reads < 30


def test_a_word_is_cut_from_the_marks_behind_it():
    own, words, asked = token_store.Encoder(PATH), [], []
    model, ask = own.tokenize, own._ask
    own.tokenize = lambda joined: words.extend(joined.split("\n")) or model(joined)
    own._ask = lambda chunks: asked.extend(chunks) or ask(chunks)
    texts = ["tree!! Tree$$$ tree. TREE*,* tree", "tree%%% tree&&& \u00e9t\u00e9!!", "tree@x.tree#"]
    got = own.encode_all(texts)
    assert got == ask(texts) and sorted(words) == ["tree", token_store.Encoder(PATH).library.pre_tokenizer.pre_tokenize_str("\u00e9t\u00e9")[0][0]]
    assert sorted(asked) == sorted(["!!", "$$$", ".", "*,*", "%%%", "&&&", "@x", ".tree", "#"])


def test_cut_texts_encode_as_the_library():
    """Every ASCII mark and every white space beside letters, digits, apostrophes, marks that compose and special tokens."""
    library, rng = Tokenizer.from_file(PATH), random.Random(12)
    own = token_store.Encoder(PATH)
    near = ["a", "T", "\u00e9", "\u00c9", "e\u0301", "H\u0331", "h\u0331", "\u0130", "\u023a", "\u03a3", "\u6f22", "1", "'s", "'LL", "'", "\u0338", "<|endoftext|>", "<|", "\x1c"]
    marks = [chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum()] + [chr(c) for c in range(0x3001) if chr(c).isspace()]
    texts = [f"{a}{m}{b}" for m in marks for a in near for b in near]
    texts += ["".join(rng.choice(near[:-3] + marks) for _ in range(rng.randint(2, 9))) for _ in range(5000)] + ["", " ", "<|endoftext|>"]
    for kind in (pa.string(), pa.large_string()):
        column = pa.array(["left out", *texts, "left out"], kind).slice(1, len(texts))
        ids, sizes = own.encode(column)
        for t, a, e in zip(texts, np.cumsum(sizes) - sizes, np.cumsum(sizes), strict=True):
            assert ids[a:e].tolist() == library.encode(t, add_special_tokens=False).ids, ascii(t)


def test_a_vocabulary_without_ends_of_words():
    own = token_store.Encoder(PATH)
    own.ends[:] = False
    texts = ["treelike, sea \u00e9t\u00e9", ""]
    assert own.encode_all(texts) == own._ask(texts)


def test_slices_hold_every_row_once(monkeypatch):
    monkeypatch.setattr(token_store, "SLICE", 10)
    texts = ["", "abc", "x" * 40, "", "de", "\u00e9" * 4, "fgh", ""]
    batch = pa.record_batch([pa.array(range(8)), pa.array(texts)], names=["doc_id", "text"])
    got = [s.column(1).to_pylist() for s in token_store._slices(batch)]
    assert sum(got, []) == texts and len(got) > 2 and all(got)
    assert [s.num_rows for s in token_store._slices(batch.slice(0, 0))] in ([], [0])


def test_lookups_inflate_what_they_touch():
    ids = np.random.default_rng(3).integers(0, 1 << 16, 1 << 20).astype(np.uint32)
    w = token_store.WaveletMatrix.from_bytes(token_store.WaveletMatrix.build(ids).to_bytes())
    assert w.access(777_777) == ids[777_777] and sum(p.inflated for p in w.planes) <= 2 * 16
    with pytest.raises(ValueError):
        token_store.WaveletMatrix.from_bytes(token_store.WaveletMatrix.build(ids).to_bytes()[:-1])


def test_rows_and_counts(spark):
    library = Tokenizer.from_file(PATH)
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["sun", "moon", "Sea.", "star"]) for _ in range(rng.randint(0, 60)))) for i in rng.sample(range(1000), 200)] + [(5000, None), (5001, ""), (None, "x"), (7000, "same"), (7000, "same")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int")
    path = new_path(spark, "t")
    token_store.write_shards(docs.repartition(3), PATH, path, shard_tokens=300)
    got = sorted((tuple(r) for r in token_store.index(spark, path).collect()), key=lambda r: r[1])
    want, start, every = [], 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        want.append((doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
        every += ids
    assert got == want and token_store.read_shards(spark, path).count() > 5
    some = [1, library.encode("moon").ids[0], 40000]
    assert {r.id: r.n for r in token_store.count_ids(spark, path, some).collect()} == {i: every.count(i) for i in some}
    moon = library.encode("moon").ids[0]
    found = {(r.doc_id, r.at) for r in token_store.occurrences(spark, path, [moon]).collect()}
    assert found == {(d, k) for d, t in rows for k, i in enumerate(library.encode(t or "", add_special_tokens=False).ids) if i == moon}
    assert token_store.stored(docs.limit(0), PATH).collect() == []
