import random
from collections import Counter

from tests.llm.oracle import frames, same

from tessera.llm import line_dedup
from tessera.llm.queries import op9_line_dedup

SF = "/root/testdata/sf0.01"


def test_query_matches_sql(spark):
    got, want = frames(spark, op9_line_dedup, line_dedup.SQL, SF)
    assert (got.n_dropped > 0).any() and len(got) == 1000
    same(got, want)


def test_frequency_is_relative_to_the_host(spark):
    rows = [(i, f"menu \nbody {i}", "a", "x") for i in range(10)] + [(100 + i, f"menu\nother {i}\n\n" if i < 1 else f"z{i}", "b", "x") for i in range(40)]
    rows += [(200, "menu", "a", "x"), (201, None, "a", "x"), (202, "", None, "x"), (10, "body 3\nmenu", "a", "x"), (10, "body 3\nmenu", "a", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lines string")
    out = line_dedup.drop_boilerplate(docs, ratio=0.5, min_pages=3, distinct_pages=True, keep_emptied=True)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    want = sorted([(i, f"body {i}") for i in range(10)] + [(r[0], r[1]) for r in rows if r[2] == "b"] + [(200, "menu"), (201, None), (202, ""), (10, "body 3"), (10, "body 3")], key=repr)
    assert got == want


def test_plain_ratio_against_brute_force(spark):
    rng = random.Random(3)
    pool = [f"line {k}" for k in range(12)] + ["", "  ", "\tline 1 "]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 6))), rng.choice(["a", "b", None]), 1) for i in range(120)] + [(None, None, None, 1), (7, "z\n" * 100_000 + "line 0", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, `a b` int")
    for ratio in (0.1, 0.3):
        pages, with_line = Counter(), Counter()
        for _, t, s, _ in rows:
            pages[s or ""] += 1
            with_line.update((s or "", x) for x in {y.strip(" \t\r") for y in (t or "").split("\n")} if x)
        want = []
        for i, t, s, o in rows:
            lines = (t or "").split("\n")
            kept = [x for x in lines if not x.strip(" \t\r") or with_line[s or "", x.strip(" \t\r")] <= ratio * pages[s or ""]]
            want.append((i, t if len(kept) == len(lines) else "\n".join(kept), s, o))
        got = line_dedup.drop_boilerplate(docs, ratio)
        assert got.columns == docs.columns and sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_host_of_a_url(spark):
    rows = [(i, f"http://Site{i % 2}.org/{i}", "menu\nx" if i % 2 else "x", 0) for i in range(10)] + [(99, "no url", "menu", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, url string, text string, source int")
    got = {r.doc_id: r.text for r in line_dedup.drop_boilerplate(docs, 0.5, min_pages=3, host=line_dedup.url_host()).collect()}
    assert got == {r[0]: "menu" if r[0] == 99 else "" for r in rows}


def test_copies_of_one_page_count_once(spark):
    docs = spark.createDataFrame([(i, "a\nb", "s") for i in range(50)] + [(99, "c\nd", "s")], "doc_id long, text string, source string")
    assert {r.text for r in line_dedup.drop_boilerplate(docs, ratio=0.4, min_pages=3, distinct_pages=True, keep_emptied=True).collect()} == {"a\nb", "c\nd"}


def test_a_line_on_eight_percent_of_a_large_host_goes_in_every_host(spark):
    shares = {"a": 16, "b": 22, "c": 30}
    rows = [(i, f"own {s} {i}\n" + ("site line" if i < n else f"other {i}") + ("\nprose" if i % 22 == 0 else ""), s) for s, n in shares.items() for i in range(200)]
    texts = [r.text for r in line_dedup.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_pages=3).collect()]
    assert not any("site line" in t for t in texts) and sum("prose" in t for t in texts) == 30


def test_empty_table(spark):
    assert line_dedup.drop_boilerplate(spark.createDataFrame([], "doc_id long, text string, source string"), counts=True).collect() == []
