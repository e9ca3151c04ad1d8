"""The pipeline: stages chain, decisions take effect, columns stay."""

import corpus_pipeline as pipe
from tracewright.llm import registry

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    start, seen = docs, [docs]
    for _, stage in pipe.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.columns == start.columns
        seen.append(docs)
    toxic, near, private, mix = seen[1:]
    judged = {r["doc_id"] for r in registry.op7_toxicity(spark, SF).collect() if r["predicted"] == 0}
    assert {r["doc_id"] for r in toxic.collect()} == judged
    assert near.count() == near.select("doc_id").distinct().count() < toxic.count()
    assert private.count() == near.count() and private.where("text rlike '[a-z]@[a-z0-9]+[.]example'").count() == 0
    assert private.where("text like '%[EMAIL]%' or text like '%[PHONE]%' or text like '%[IP]%'").count() > 0
    out = pipe.STAGES[-1][1](spark, mix, SF)
    assert out.count() == mix.count() and out.where("n_tokens <> size(token_ids)").count() == 0


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in pipe.STAGES:
        assert stage(spark, docs, SF).count() == 0
