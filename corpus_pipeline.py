"""The training-data pipeline: five stages, each over all that the one before kept.

Every stage takes (spark, docs, folder of tables) and returns a DataFrame; it is
written as Parquet in the shared folder and read again as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm import bpe_stream, decontaminate, jaccard_tree, quality_rules, secrets
from quillmesh.llm.common import fresh_name
from quillmesh.plans.registry import Tables
from quillmesh.session import materialise, tune


# Workers outlive their stage with what it took, beside those of the next one; a batch is read, worked on
# and written in several copies by each of them.
BATCH_BYTES = "2m"


def _ready(spark: SparkSession) -> None:
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality policy rejects."""
    _ready(spark)
    whole = docs.select(F.struct(*docs.columns).alias("__row"), F.col("text").alias("__text"))
    judged = quality_rules.apply_policy(quality_rules.ledger(whole, "__text"))
    return judged.filter("kept").select("__row.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the smallest id, of each group of linked documents.

    Five words and 0.8 keep edited copies together up to about 2.2 % of changed
    words; op8's three words and 0.9 would part them from 1.75 % on.
    """
    _ready(spark)
    return jaccard_tree.one_per_component(docs, size=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that reproduce a benchmark item."""
    items = Tables(spark, sf_dir).benchmark  # tunes the session itself
    _ready(spark)
    return decontaminate.clean(docs, items)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Redact secrets that look live; widely copied examples and all else stay."""
    _ready(spark)
    return secrets.redact(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode: all columns but the text, ``n_tokens``, ``ids`` and digests of the ids and of what they decode to."""
    _ready(spark)
    file = public_tokenizers.path("word_bpe_49k.json")
    keep = tuple(c for c in docs.columns if c not in ("text", "n_tokens", "ids", "ids_sha256", "decoded_sha256"))
    ids, text = fresh_name(docs, "__ids"), fresh_name(docs, "__decoded")
    encoded = bpe_stream.encode(docs, file, keep)
    decoded = bpe_stream.decode(encoded.withColumn(ids, F.col("ids")), file, out=text)
    return decoded.select(
        *keep,
        "n_tokens",
        F.col(ids).alias("ids"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2(text, 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality_rules", quality_stage),
    ("jaccard_join", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("secret_scans", secret_stage),
    ("bpe_encoding", token_stage),
]

# The last stage runs a tokenizer, which SQL cannot express; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = Tables(spark, sf_dir).documents
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
