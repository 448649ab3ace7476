import random
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import divergence, queries
from tests.llm.oracle import frames, same


def slow(rows, least, top=50):
    """The audit by its definition, every pair over the whole vocabulary."""
    docs = [(lang or "", source or "", ["".join(c.lower() if c < "\x80" else c for c in t) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t, n in seen.items() if n >= least)
        counts = {s: Counter(t for d in own if d[1] == s for t in d[2] if t in set(kept)) for s in {d[1] for d in own}}

        def shares(c):
            total = sum(c.values())
            return {t: 1 + 1000000000 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = {s: shares(c) for s, c in counts.items()}
        q = shares(sum(counts.values(), Counter()))
        for s in p:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in p if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if counts[s][t] > 0 and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                for i, (v, x) in enumerate(sorted(items, key=lambda e: (-e[0], e[1].encode()))[:most]):
                    out.append((lang, s, part, x, v, i + 1))
    return sorted(out)


def odd_rows():
    rng = random.Random(0)
    words = ["a", "The", "THE", "the", "été", "Éte", "ÉTE", "日本語", "x1y", "don't", "zzz", "q", "b", "c", "dd", "d", "𝒳", "\u0080ÿ"]
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 30))), rng.choice(["en", "de", "fr"]), rng.choice("stuv")) for _ in range(150)]
    rows += [(None, "en", "s"), ("", "en", "empty"), ("the the", None, None), ("the", "", None), ("the a", None, "s"), ("\x00the\x7fa", "en", None)]
    rows += [("w" * 50_000 + " the " * 20_000, "en", "long")] + [("the copy", "en", "copies")] * 40 + [("alone", "one", "s")] + [("rare", "none", s) for s in "pqr"]
    return rows


def test_odd_rows_against_brute_force(spark, monkeypatch):
    rows = odd_rows()
    want = slow(rows, 6)
    docs = spark.createDataFrame([(t, la, s, "n", 1) for t, la, s in rows], "text string, lang string, source string, term string, n int")
    got = divergence.audit(docs, min_docs=6)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == want
    # the same through several automata, flushed counters, and many blocks of terms and sources
    for name, v in (("HELD", 5), ("BLOCK_TERMS", 3), ("BLOCK_SOURCES", 2)):
        monkeypatch.setattr(divergence, name, v)
    assert sorted(map(tuple, divergence.audit(docs, min_docs=6, part_terms=3, part_bytes=9).collect())) == want
    assert sorted(map(tuple, divergence.audit(docs, min_docs=6, top_terms=2).collect())) == slow(rows, 6, 2)


def test_nothing_kept_and_empty_tables(spark):
    docs = spark.createDataFrame([("a b", "en", s) for s in "xyz"], "text string, lang string, source string")
    got = sorted(map(tuple, divergence.audit(docs).collect()))
    assert got == slow([tuple(r) for r in docs.collect()], 30) and len(got) == 6
    assert divergence.audit(docs.limit(0)).collect() == []


def test_shares_of_large_counts_are_exact(spark):
    counts = [(0, 0, 1), (3, 10**13, 10**7), (10**15, 10**15 + 7, 123), (999_999_999_999, 10**16 + 1, 10**8)]
    got = spark.createDataFrame(counts, "n long, total long, v long").select(divergence._share(F.col("n"), F.col("total"), F.col("v")).alias("p")).collect()
    assert [r.p for r in got] == [1 + 1000000000 * (n + 5) // (t + 5 * v) for n, t, v in counts]


def test_query_matches_sql(spark):
    same(*frames(spark, queries.QUERIES["op12_source_divergence"], queries.ORACLE_SQL["op12_source_divergence"], "/root/testdata/sf0.01"))


def test_a_task_hands_on_numbers_of_terms():
    """Whole numbers, not the terms' text, leave the task; they are named after counting."""

    class Shared:
        value = ["a", "caf\u00e9", "the"]

    rows = [("en", "s", "The the caf\u00e9 other"), ("en", "t", ""), ("de", "s", "the")]
    docs = pa.RecordBatch.from_pylist([dict(zip(("lang", "source", "text"), r, strict=True)) for r in rows])
    for most, n in ((100, 1), (0, 2)):
        got = list(divergence._recount(Shared, most)(iter([docs])))
        assert len(got) == n and all(b.schema.field("id").type == pa.int32() for b in got)
        named = [tuple(r.values()) for b in divergence._named(Shared)(iter(got)) for r in b.to_pylist()]
        assert sorted(named) == [("de", "s", "the", 1), ("en", "s", "caf\u00e9", 1), ("en", "s", "the", 2)]
    assert list(divergence._recount(Shared, 9)(iter([]))) == []
