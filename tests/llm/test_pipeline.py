"""The pipeline's stages on a sample; the registered queries' columns."""

import corpus_pipeline
from twinlens.llm import quality_rules
from twinlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = start = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r["doc_id"] for r in docs.collect()}
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.saved(stage(spark, docs, SF), "test")
        rows = docs.select("doc_id").collect()
        assert {r["doc_id"] for r in rows} <= ids
        ids = {r["doc_id"] for r in rows}
        seen.append((name, docs))
        if name != "packing":
            assert docs.columns == start.columns
    by = dict(seen)
    kept = by["quality rules"]
    verdicts = quality_rules.apply_rules(by["toxicity"]).select("kept").collect()
    assert sum(r["kept"] for r in verdicts) == kept.count()
    assert by["n-gram Jaccard join"].select("doc_id").distinct().count() == by["n-gram Jaccard join"].count()
    assert by["packing"].agg({"length": "sum"}).first()[0] > 0


def test_empty_documents(spark, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_one_query_an_operator():
    assert [q.split("_")[0] for q in QUERIES] == [f"op{n}" for n in range(1, 11)]
