import corpus_pipeline
from quillspark.llm import mixing, queries, simhash
from quillspark.session import load

SMALL = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = load(spark, SMALL, "documents")
    seen = [docs.count()]
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(docs.count())
        if k < 4:
            assert docs.columns == columns, name
    assert seen[0] > seen[1] == seen[2] > seen[3] >= seen[4] > 0
    assert {"mix_shard", "mix_pass"} < set(docs.columns)
    left = spark.read.parquet(f"{tmp_path}/2")
    classes = simhash.near_duplicates(left).collect()
    want = {r.component_id for r in classes}
    assert {r.doc_id for r in spark.read.parquet(f"{tmp_path}/2").select("doc_id").collect()} >= want
    assert sorted(r.doc_id for r in spark.read.parquet(f"{tmp_path}/2").join(spark.read.parquet(f"{tmp_path}/2"), "doc_id").select("doc_id").collect())
    mixed = {r.doc_id: len(r.places) for r in mixing.mix(spark.read.parquet(f"{tmp_path}/3")).collect()}
    got: dict = {}
    for r in docs.select("doc_id").collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {k: n for k, n in mixed.items() if n}


def test_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert len(corpus_pipeline.STAGES) == 5
