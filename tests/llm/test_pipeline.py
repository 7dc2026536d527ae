"""The pipeline's contract, and its decisions against those of the single operators."""

import corpus_pipeline
from veldspar.llm import queries


def test_stages_return_document_columns_and_keep_what_operators_keep(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    out = docs
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialize(stage(spark, out, sf_dir), f"test-{name}")
        assert out.columns[: len(columns)] == columns and (name == names[-1] or out.columns == columns)
    last = {r.doc_id: r for r in out.collect()}
    dirty = {r.doc_id for r in queries.op6_decontamination(spark, sf_dir).collect() if r.contaminated}
    failed = {r.doc_id for r in queries.op2_quality_rules(spark, sf_dir).collect() if r.base_failed}
    assert last and not set(last) & dirty and not set(last) & failed
    whole = {r.doc_id: r.component_id for r in queries.op10_simhash(spark, sf_dir).collect()}
    assert len({whole[k] for k in last}) == len(last)
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()} == set(last)


def test_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0


def test_odd_rows_and_extra_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    odd = [(900_001, None, None, None, None), (None, "No id here", "en", "a", 1), (900_003, "", "en", "a", 0), (900_004, " \t\n", "en", None, 3), (900_005, "é" * 50_000, "fr", "b", 5), (900_006, "Same text", "en", "a", 9), (900_006, "Same text", "en", "a", 9)]
    both = docs.unionByName(spark.createDataFrame(odd, docs.schema)).selectExpr("*", "'x' as _vs_row", "1 as fp", "true as kept", "'y' as taken", "2 as row", "'z' as c0")
    out, columns = both, both.columns
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialize(stage(spark, out, sf_dir), f"odd-{name}")
        assert [c for c in columns if c in out.columns] == [c for c in columns if c != "taken" or name != "mixing"] or out.columns[: len(columns) - 1] == [c for c in columns if c != "taken"]
    ids = {r.doc_id for r in out.collect()}
    assert ids and not ids & {900_001, 900_003, 900_004, 900_005, 900_006, None}
    assert out.filter("_vs_row <> 'x' or fp <> 1 or row <> 2 or c0 <> 'z'").count() == 0
