import corpus_pipeline
from setloom.llm.decontaminate import leaks
from setloom.llm.mixing import mixed
from setloom.llm.near_dup import near_duplicates
from setloom.llm.quality_pu import score_quality, train

SF = "/root/testdata/sf0.001"


def test_each_stage_does_what_its_operator_decides(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "mixing", "sharding"]
    for name, stage in corpus_pipeline.STAGES:
        out = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(out)
        after = spark.read.parquet(out)
        ids, kept = {r.doc_id for r in docs.collect()}, {r.doc_id for r in after.collect()}
        if name == "quality":
            want = {r.doc_id for r in score_quality(docs, train(docs, spark.read.parquet(f"{SF}/labels.parquet"))).collect() if r.keep}
        elif name == "near_dedup":
            want = ids - {r.doc_id for r in near_duplicates(docs).collect() if r.doc_id != r.group_id}
        elif name == "decontaminate":
            want = ids - {r.doc_id for r in leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
        elif name == "mixing":
            want = {r.doc_id for r in mixed(docs).collect() if r.selected}
        else:
            want = ids
        assert kept == want
        assert after.columns == columns + (["hilbert", "shard"] if name == "sharding" else [])
        same = after.select(columns).exceptAll(docs.select(columns))
        assert same.count() == 0
        docs = after


def test_stages_on_no_documents(spark):
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
