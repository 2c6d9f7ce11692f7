"""The pipeline's stages in order, each against what it must do to its input."""

import numpy as np

import corpus_pipeline
from test_operators import brute_classes
from lexispan.llm import divergence, mixing, secrets
from lexispan.llm.common import cut


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(120)
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, cut(stage(spark, docs, sf_dir), f"t{k}")
        if k < 4:
            assert docs.columns == columns
        seen[name] = (before, docs)
    before, after = seen["quality rules"]
    kept = {r.doc_id for r in divergence.judge(before).filter("kept").collect()}
    assert {r.doc_id for r in after.collect()} == kept
    before, after = seen["near-duplicates"]
    want = brute_classes([(r.doc_id, r.text) for r in before.collect()])
    assert sorted(r.doc_id for r in after.collect()) == sorted({c for _, c in want})
    text = {r.doc_id: tuple(r) for r in before.collect()}
    assert all(tuple(r) == text[r.doc_id] for r in after.collect())
    before, after = seen["secret scans"]
    assert after.count() == before.count()
    assert not any(s[2] != "assign" for r in after.collect() for s in secrets.scan(r.text))
    before, after = seen["mixture"]
    assert after.count() == sum(r._copies for r in mixing.choose(before).collect())
    before, packed = seen["packing"]
    n = packed.groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in n) <= 2048
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in before.collect()}
    assert all(len(np.frombuffer(r.ids, "<u2")) == r.length for r in packed.collect())


def test_empty(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = cut(stage(spark, docs, sf_dir), f"e{k}")
    assert docs.count() == 0
