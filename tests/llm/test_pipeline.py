import hashlib
import struct
from pathlib import Path

import corpus_pipeline
import pandas as pd
import pytest
import tiktoken

from tessera.llm import byte_bpe, line_dedup
from tessera.llm.common import shared_dir
from tests.llm.test_shingle_dedup import slow_groups

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        seen[name] = (docs.toPandas(), out.toPandas())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            docs = spark.createDataFrame(seen[name][1], docs.schema)
    before, after = seen["toxicity"]
    assert set(after.doc_id) <= set(before.doc_id) and len(after) > 0.8 * len(before)
    before, after = seen["line dedup"]
    assert sorted(before.doc_id) == sorted(after.doc_id)
    texts = before.drop_duplicates(["source", "text"])
    for s, own in texts.groupby("source"):
        lines = pd.Series([x for t in own.text for x in {y.strip(" \t\r") for y in t.split("\n")} if x]).value_counts()
        bad = {x for x, n in lines.items() if n >= 3 and n / len(own) > line_dedup.RATIO}
        for t, got in zip(before[before.source == s].text, after.set_index("doc_id").loc[before[before.source == s].doc_id].text, strict=True):
            kept = [x for x in t.split("\n") if x.strip(" \t\r") not in bad]
            assert got == ("\n".join(kept) if any(x.strip() for x in kept) else t)
    before, after = seen["near duplicates"]
    ids = before.doc_id.tolist()
    least = {}
    for i, g in zip(ids, slow_groups(before.text.tolist()), strict=True):
        least[g] = min(i, least.get(g, i))
    assert sorted(after.doc_id) == sorted(least.values())
    before, after = seen["mixing"]
    assert sorted(before.doc_id) == sorted(after.doc_id)
    before, after = seen["byte-level BPE"]
    assert sorted(before.doc_id) == sorted(after.doc_id) and after.decoded_equal.all()


def test_run_is_the_stages_in_order(spark):
    top = Path(shared_dir(spark).removeprefix("file://")) / "tessera"
    before = set(top.iterdir()) if top.exists() else set()
    out = corpus_pipeline.run(spark, SF)
    left = {p.name.rsplit("-", 1)[0] for p in set(top.iterdir()) - before}
    assert left == {"mixing", "source-sizes", "mixing-plan", "places", "tokens"}  # the output that the last stage reads, and its own
    assert 0 < out.count() < 200 and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns)


def test_odd_rows_pass_every_stage(spark):
    """Nulls, empties, long texts, ties, repeated rows, clashing and odd column names."""
    base = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "text", "lang", "source", "n_chars")
    odd = [(None, None, None, None, None), (None, "", "en", None, 0), (10**9, "odd words " * 60_000, "en", "src1", 1), (10**9 + 1, "tie tie", "en", "src1", 1), (10**9 + 1, "tie tie", "en", "src1", 1), (10**9 + 1, "other text here", "en", "src1", 1), (10**9 + 2, "   \n \n", "en", "src2", 1)]
    docs = base.union(spark.createDataFrame(odd, base.schema))
    docs = docs.selectExpr("*", "doc_id AS toxicity_score", "1 AS `a b`", "2 AS `text:x`", "3 AS row", "4 AS host", "5 AS lines", "6 AS slot", "7 AS node", "8 AS k", "9 AS own_id", "10 AS score")
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, SF)
        rows = out.collect()
        if name == "near duplicates":
            texts = now.toPandas().text.tolist()
            assert len(rows) == len(set(slow_groups(texts)))
        elif name == "toxicity":
            assert {10**9, 10**9 + 1, 10**9 + 2, None} <= {r.doc_id for r in rows} and sum(r.doc_id == 10**9 + 1 for r in rows) == 3
        else:
            assert len(rows) == now.count(), name
        if stage is not corpus_pipeline.tokenize:
            assert out.schema.simpleString() == docs.schema.simpleString(), name
            now = spark.createDataFrame(rows, docs.schema)
    path, pattern = byte_bpe.public_ranks()
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    want = []
    for r in now.collect():
        ids = encoding.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256)) for r in rows)


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_empty_tables(spark, name, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    out = stage(spark, docs, SF)
    assert out.collect() == [] and (stage is corpus_pipeline.tokenize or out.columns == docs.columns)
