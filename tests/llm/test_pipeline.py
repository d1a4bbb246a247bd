"""Every stage of the pipeline against a plain version, on what its predecessor kept."""

from helpers import line_windows, near_components, shingles, words

import corpus_pipeline
from sentiloom.llm.toxicity import toxicity

SMALL = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    benchmark = [shingles(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    columns = docs.dtypes
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, SMALL).collect(), stage(spark, docs, SMALL).schema)
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.count() == len(after) and set(after) <= set(before)
        if name == "toxicity":
            bad = {r.doc_id for r in toxicity(spark.createDataFrame(list(before.values()), docs.schema), spark.read.parquet(f"{SMALL}/labels.parquet")).collect() if r.rejected}
            assert set(before) - set(after) == bad
        elif name == "line_dedup":
            want = line_windows([(k, r.text) for k, r in before.items()])
            assert {k: r.text for k, r in after.items()} == want and set(after) == set(before)
            assert all(r.n_chars == len(r.text) for k, r in after.items() if r.text != before[k].text)
        elif name == "near_dedup":
            assert set(after) == {d for d, _, c in near_components([(k, r.text) for k, r in before.items()]) if d == c}
        elif name == "decontamination":
            held = {k for k, r in before.items() if any(4 * len(b & shingles(r.text)) >= 3 * len(b) for b in benchmark if b)}
            assert set(before) - set(after) == held
        else:
            assert all(0 < r.taken <= 2 * r.size and r.size == len(words(r.text)) for r in after.values())
            total = sum(len(words(r.text)) for r in before.values())
            assert abs(sum(r.taken for r in after.values()) - 1.5 * total) < 0.05 * total
        if name != "mixing":
            assert docs.dtypes == columns


def test_run(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "taken"] and 0 < out.count() < 200
