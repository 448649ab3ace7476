import corpus_pipeline

from tessera.llm import mixing


def test_order_of_mixing_survives_several_files(spark, tmp_path):
    rows = [(i, "word " * (i * 37 % 900), ["hot", "hot", "b", None][i % 4]) for i in range(600)] + [(7, "copy", "b")] * 2 + [(None, "x", "b"), (None, "y", "b"), (8, None, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = mixing.mixed(docs).collect()
    mixing.mixed(docs).repartition(8).write.parquet(str(tmp_path / "mixed"))
    out = corpus_pipeline.tokenize(spark, spark.read.parquet(str(tmp_path / "mixed")), "").collect()
    assert len(out) == len(rows) and len({(r.slot, r.position) for r in out}) == len(rows)
    out.sort(key=lambda r: (r.slot, r.position))
    assert [(r.doc_id, r.source) for r in out] == [(r.doc_id, r.source or "") for r in want]
    slots = {}
    for r in out:
        slots.setdefault(r.slot, set()).add((r.source, r.block))
    assert all(len(x) == 1 for x in slots.values())
    switches = sum(a.source != b.source for a, b in zip(out, out[1:], strict=False))
    assert switches > 10
