from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing
from tessera.llm.queries import op7_pfair_mixing
from tests.llm.oracle import frames, same

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string"


def test_query_matches_sql(spark):
    same(*frames(spark, op7_pfair_mixing, mixing.SQL, SF))


def deviation(weights, slots_of):
    """The largest distance in blocks, over all slots, between what a source has run and its share of the given weights."""
    total = sum(weights)  # extremes are just before and just after a block runs
    return max(max(abs(j * total - w * t), abs((j + 1) * total - w * (t + 1))) for w, own in zip(weights, slots_of, strict=True) for j, t in enumerate(own)) / total


@pytest.mark.parametrize("weights", [[1], [50, 31, 7, 12], [1, 9999, 3333, 250, 17], [997000, 2500, 333, 167], list(range(1, 301)), [1] * 7 + [10**5]])
def test_deviation_from_the_given_weights_is_less_than_one_block(weights):
    total = sum(weights)
    got = mixing.earliest_deadline_first([(w, w) for w in weights], total)
    assert sorted(t for x in got for t in x) == list(range(total)) and [len(x) for x in got] == weights
    assert all(j * total // w <= t < -(-(j + 1) * total // w) for w, x in zip(weights, got, strict=True) for j, t in enumerate(x))
    assert deviation(weights, got) < 1


@pytest.mark.parametrize("shares", [[(3, 100), (2, 7), (5, 61), (1, 1)], [(1, 50)], [(7, 3), (11, 2)], [(2, 40), (2, 0), (3, 1)]])
def test_periods_give_the_slots_of_the_plain_plan(shares):
    p = sum(a for a, _ in shares)
    want = [list(x) for x in mixing.earliest_deadline_first(shares, p)]
    planned = list(mixing.phases(shares, p, plain_slots=0))
    got = [[] for _ in shares]
    for first, times, ats in planned:
        for cycle in range(first, first + times):
            for i, x in ats.items():
                got[i] += [cycle * p + t for t in x]
    assert got == want


@pytest.mark.parametrize("n", [3000, 10_000])
def test_many_sources_with_different_weights(spark, n):
    rows = [(i * 8 + k, "x" * 16, f"s{i}") for i in range(n) for k in range(3)]
    weights = {f"s{i}": i + 1 for i in range(n)}
    got = mixing.slots(spark.createDataFrame(rows, SCHEMA), block_bytes=16, weights=weights).collect()
    total = sum(weights.values())
    assert len(got) == len(rows) and len({r.slot for r in got}) == len(rows)
    for r in got:
        w = weights[r.source]
        assert (r.release, r.deadline) == (r.block * total // w, -(-(r.block + 1) * total // w)) and r.release <= r.slot < r.deadline


def test_many_periods_keep_the_exact_share(spark):
    rows = [(i, "x" * 64, "big" if i % 50 else "small") for i in range(10_000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    weights = {"small": 2, "big": 98}
    got = mixing.slots(docs, block_bytes=64, weights=weights).collect()
    assert len(got) == len(rows) == len({r.slot for r in got})
    assert {tuple(r) for r in mixing._scheduled(docs, 64, weights, "source", [F.col("doc_id")], plain_slots=0).select("row.doc_id", "source", "block", "release", "deadline", "slot").collect()} == {tuple(r) for r in got}
    own = [sorted(r.slot for r in got if r.source == s) for s in weights]
    assert deviation(list(weights.values()), own) < 1 and max(map(max, own)) > 150 * 50
    order = {r.doc_id: r.slot for r in got}
    slots_in_order = [order[r.doc_id] for r in mixing.mixed(docs, block_bytes=64, weights=weights).collect()]
    assert slots_in_order == sorted(slots_in_order)


def test_every_row_once_in_slot_order(spark):
    rows = [(i, ("x" * (i % 50)) if i % 7 else None, ["hot", "hot", "b", None][i % 4], 9) for i in range(400)] + [(1, "dup", "b", 9)] * 2 + [(None, "y" * 5000, "b", 9), (None, "z", "b", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, slot int").withColumnRenamed("slot", "ats")
    out = mixing.mixed(docs, block_bytes=64)
    assert out.columns == docs.columns
    assert sorted(map(repr, out.collect())) == sorted(map(repr, docs.collect()))
    got = mixing.slots(docs, block_bytes=64, weights={"hot": 3, "b": 1}).collect()
    assert len(got) == len(rows)
    by_slot = defaultdict(set)
    for r in got:
        assert r.release <= r.slot < r.deadline
        by_slot[r.slot].add((r.source, r.block))
    assert all(len(x) == 1 for x in by_slot.values())


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.slots(empty).collect() == [] and mixing.mixed(empty).collect() == []
    one = spark.createDataFrame([(None, None, None)], SCHEMA)
    assert [tuple(r) for r in mixing.slots(one).collect()] == [(None, "", 0, 0, 1, 0)]
