from pathlib import Path

from conftest import SF

import corpus_pipeline
from tidewave.llm import decontam, near_dedup, pii, sp_encode
from tidewave.llm.shared_store import staged


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, left = docs.columns, docs
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "personal_data", "sentencepiece"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = staged(stage(spark, left, SF))
        assert got.columns == columns
        before, after = ({r.doc_id: r.text for r in x.collect()} for x in (left, got))
        assert set(after) <= set(before)
        if name == "near_dedup":
            kept = {r.doc_id for r in near_dedup.near_duplicates(left).collect() if r.kept}
            assert set(after) == kept
        if name == "decontamination":
            bench = spark.read.parquet(f"{SF}/benchmark.parquet")
            assert set(after) == {r.doc_id for r in decontam.decontaminate(left, bench).collect() if not r.contaminated}
        if name == "personal_data":
            assert set(after) == set(before) and not any(pii.base_spans(t or "") for t in after.values())
        left = got
    sp = sp_encode.processor(Path(sp_encode.default_model()).read_bytes())
    ids = {r.doc_id: r.ids for r in corpus_pipeline.STAGES[-1][1](spark, left, SF).collect()}
    assert ids == {r.doc_id: sp.encode(r.text or "") for r in left.collect()}


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
