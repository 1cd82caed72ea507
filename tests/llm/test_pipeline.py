"""The pipeline's stages against the operators' decisions and brute force."""

from __future__ import annotations

from collections import defaultdict

import corpus_pipeline
from test_dedup import LOWER, brute_components, brute_fingerprint

from tidesift.llm.quality_rules import judge
from tidesift.llm.toxicity import fit_toxicity


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    columns = docs.columns
    rows = docs

    def ids(df):
        return sorted(r["doc_id"] for r in df.select("doc_id").collect())

    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality_rules", "exact_dedup", "near_dedup", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = rows.collect()
        after = stage(spark, rows, sf_dir)
        assert after.columns == columns
        if name == "toxicity":
            want = [r["doc_id"] for r in fit_toxicity(rows, labels).score(rows).collect() if not r["predicted"]]
        elif name == "quality_rules":
            want = [r["doc_id"] for r in judge(rows).collect() if r["kept"]]
        elif name == "exact_dedup":
            groups = defaultdict(list)
            for r in before:
                groups[r["text"].translate(LOWER)].append(r["doc_id"])
            want = [max(g) for g in groups.values()]
        else:
            fps = {r["doc_id"]: brute_fingerprint(r["text"]) for r in before}
            linked = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2]
            want = set(brute_components(fps, linked).values())
        assert ids(after) == sorted(want)
        texts = {r["doc_id"]: tuple(r) for r in before}
        kept = after.collect()
        assert all(tuple(r) == texts[r["doc_id"]] for r in kept)
        rows = spark.createDataFrame(kept, docs.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, rows, sf_dir)
    whole = corpus_pipeline.run(spark, sf_dir)
    assert ids(packed) == ids(whole)
    assert set(ids(whole)) == set(ids(rows))


def test_stages_of_odd_rows(spark, sf_dir, odd_docs):
    for docs in (odd_docs, odd_docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            assert out.count() <= docs.count() or name == "packing"
            if name != "packing":
                assert out.columns == docs.columns
