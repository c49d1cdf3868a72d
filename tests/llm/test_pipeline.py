"""The pipeline against a plain pass over the same rows, and the queries' registration."""

import re

import public_tokenizers
import pyarrow as pa
from brute import base_spans, components, quality_row, sha
from tokenizers import Tokenizer

import __spark_entry__ as entry_module
import corpus_pipeline
from quillmesh.llm import bpe_stream, common, quality_rules

SF = "/root/testdata/sf0.001"


def read(spark, name):
    return [r.asDict() for r in spark.read.parquet(f"{SF}/{name}.parquet").collect()]


def extra_rules(text):
    n, chars, symbols, duplicates, _, failed = quality_row(text)
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\f\r")]
    letters = [c for c in text if c.isalpha()]
    return failed or (
        10 * symbols > n or 100 * duplicates > 30 * len(lines) or chars < 2 * n or chars > 20 * n
        or 2 * sum(c.isupper() for c in letters) > len(letters) or 2 * len(letters) < chars
    )


def test_pipeline_equals_brute_force(spark):
    docs = [d for d in read(spark, "documents") if not extra_rules(d["text"])]
    label = components([(d["doc_id"], d["text"]) for d in docs], percent=80, size=5)  # the stage's own parameters
    docs = [d for d in docs if label[d["doc_id"]][1] == d["doc_id"]]
    words = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    items = [words(b["text"]) for b in read(spark, "benchmark")]
    docs = [d for d in docs if not any(i in words(d["text"]) for i in items)]
    owners = {}
    for d in docs:
        for start, _, end, kind in base_spans(d["text"]):
            value = re.split(r"[:=]\x20*[\"']?", d["text"][start:end], maxsplit=1)[-1] if kind == "assign" else d["text"][start:end]
            owners.setdefault(value, set()).add(d["source"])
            d.setdefault("hits", []).append((start, end, value))
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    wanted = {}
    for d in docs:
        text, at = "", 0
        for start, end, value in sorted(d.get("hits", [])):
            if len(owners[value]) <= 4 and len(set(value)) >= 8 and end > at:
                if start >= at:
                    text += d["text"][at:start] + "[REDACTED]"
                at = end
        text += d["text"][at:]
        ids = own.encode(text, add_special_tokens=False).ids
        wanted[d["doc_id"]] = (len(text), len(ids), sha(own.decode(ids, skip_special_tokens=False)))
    found = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"]: (r["n_chars"], r["n_tokens"], r["decoded_sha256"]) for r in found.collect()} == wanted
    assert found.count() == len(wanted) > 50


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40).withColumnRenamed("n_chars", "n_chars")
    docs = docs.selectExpr("*", "1 as n_words", "'x' as rule_mask", "2 as __text_key2", "'y' as key")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() <= 40, name


def test_policies_name_known_rules():
    for rules in quality_rules.POLICIES.values():
        assert set(rules) <= set(quality_rules.RULES)


def test_all_queries_are_registered():
    names = list(entry_module.queries())
    assert "pipeline" in names and [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13
    assert set(entry_module.oracle_sql()) <= set(names)


def test_stages_take_batches_of_two_megabytes(spark):
    docs = spark.createDataFrame([(k, "a", "word " * 1000) for k in range(2000)], "doc_id long, source string, text string").coalesce(1)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    for name, stage in corpus_pipeline.STAGES:
        if name != "jaccard_join":  # runs jobs of its own before it returns
            stage(spark, docs, "/root/testdata/sf0.001")
            largest = max(r["n"] for r in docs.mapInArrow(sizes, "n long").collect())
            assert largest < 3 << 20, name


def test_worker_keeps_only_the_tables_of_its_operator():
    file = public_tokenizers.path("word_bpe_49k.json")
    bpe_stream._words(file)["word"]
    common.release_others("quillmesh.llm.bpe_stream")
    assert bpe_stream.load.cache_info().currsize == bpe_stream._words.cache_info().currsize == 1
    common.release_others("quillmesh.llm.jaccard_tree")
    assert bpe_stream.load.cache_info().currsize == bpe_stream._words.cache_info().currsize == 0


def test_operators_release_tables_before_their_first_batch():
    class Table:
        def mapInArrow(self, run, schema):
            return run

    bpe_stream._words(public_tokenizers.path("word_bpe_49k.json"))
    run = common.map_batches(Table(), "n long", lambda batch: iter(()))
    assert list(run(iter(()))) == [] and bpe_stream.load.cache_info().currsize == 0
