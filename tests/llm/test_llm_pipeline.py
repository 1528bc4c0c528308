"""The pipeline over the smallest tables, stage by stage."""

import corpus_pipeline
from canvass.llm.common import settle, table
from canvass.llm.minhash import near_duplicates
from canvass.llm.quality_rules import rule_report

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = settle(stage(spark, docs, SF))
        if name == "quality_rules":
            assert out.count() == rule_report(docs).where("kept").count()
        if name == "near_dedup":
            assert out.count() == near_duplicates(docs).select("class_id").distinct().count()
        if name in ("suffix_dedup", "mixing"):
            assert out.select("doc_id").distinct().count() == docs.count()
        if i + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns
        else:
            assert out.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
        docs = out
