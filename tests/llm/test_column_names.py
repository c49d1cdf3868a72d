"""Every stage on a table that carries the operators' own column names: all other columns keep their values."""

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"
NAMES = [
    "__row", "__text", "__body", "__words", "__lines", "__text_key", "__cuts", "__tail", "__kept_id", "__rows", "__n", "__keep",
    "text_key", "row_id", "item_id", "rule_mask", "kept", "n_words", "node", "key", "component_id", "ids_kept", "decoded", "owner", "found",
]


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_columns_of_any_name_stay(spark, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 60")
    wide = docs.selectExpr("*", *[f"concat('{n}', doc_id) as `{n}`" for n in NAMES])
    name, run = corpus_pipeline.STAGES[stage]
    plain = {r["doc_id"]: r for r in run(spark, docs, SF).collect()}
    found = run(spark, wide, SF)
    rows = {r["doc_id"]: r for r in found.collect()}
    assert rows.keys() == plain.keys() and len(rows) > 5, name
    for doc_id, row in rows.items():
        kept = row.asDict()
        assert all(kept[n] == f"{n}{doc_id}" for n in NAMES if n in kept), name
        assert set(NAMES) - kept.keys() <= {"n_tokens"}, name
        assert all(kept[c] == plain[doc_id][c] for c in docs.columns if c in kept), name
