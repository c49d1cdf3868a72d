"""The named queries of the operators: thin applications with production parameters to whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm import (
    bpe_stream,
    decontaminate,
    importance,
    jaccard_tree,
    language_id,
    licenses,
    periodic_runs,
    preference,
    quality_rules,
    rank_queue,
    secrets,
    token_counts,
    whitening,
)
from quillmesh.llm.oracles import ORACLES
from quillmesh.plans.registry import Tables


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return token_counts.count_tokens(t.documents, public_tokenizers.path("piece_bpe_32k.model"))


def op2_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return importance.resample(t.documents, t.labels)


def op3_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    file = public_tokenizers.path("word_bpe_49k.json")
    encoded = bpe_stream.encode(t.documents, file)
    digests = encoded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"))
    decoded = bpe_stream.decode(digests, file)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_preference_formatting(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    turns = preference.materialise(preference.positions(t.conversations), "turns")
    siblings = preference.sides_of(preference.sibling_pairs(turns), turns)
    return preference.format_pairs(siblings.union(preference.stale_reply_pairs(turns)))


def op5_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    found = decontaminate.matches(t.documents, t.benchmark)
    return found.select("doc_id", "item_id", "item_words", "covered", "coverage", "n_tiles", "reordered")


def op6_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan(Tables(spark, folder).documents)


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    rows = quality_rules.ledger(Tables(spark, folder).documents.select("doc_id", "text"))
    base = F.col("rule_mask").bitwiseAND(F.lit(quality_rules.policy_mask(quality_rules.BASE)).cast("long"))
    return quality_rules.apply_policy(rows).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (base != 0).alias("base_failed"),
        "kept",
        "rule_mask",
    )


def op8_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_tree.link_components(Tables(spark, folder).documents)


def jaccard_link_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The join of op8 with the number of links; beside it, as the SQL of op8 has no such column."""
    return jaccard_tree.link_counts(Tables(spark, folder).documents)


def op9_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(Tables(spark, folder).documents).drop("expressions", "satisfied")


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = Tables(spark, folder).documents
    return language_id.identify(docs, language_id.learn(docs))


def with_planted_repetitions(docs: DataFrame) -> DataFrame:
    """One document of ten, by its id, repeats a stretch of its own words to its end; the others stay as they are."""
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    number = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, n = F.floor(number / 10), F.col("__n")
    chosen = docs.withColumn("__words", F.when(number % 10 == 0, words)).withColumn("__n", F.size("__words").cast("long"))
    start = (g % F.greatest(n, F.lit(1))).cast("int")
    period = (1 + F.floor((n - start) / (3 + g % 8))).cast("int")
    rest = (n - start).cast("int")
    times = F.ceil(rest / period).cast("int")
    repeated = F.slice(F.flatten(F.array_repeat(F.slice("__words", start + 1, period), times)), F.lit(1), rest)
    planted = F.array_join(F.concat(F.slice("__words", F.lit(1), start), repeated), " ")
    return chosen.withColumn("text", F.when(n > 0, planted).otherwise(F.col("text"))).drop("__words", "__n")


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = Tables(spark, folder).documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return periodic_runs.digests(periodic_runs.find(with_planted_repetitions(docs)))


def op12_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    vectors = whitening.grid(Tables(spark, folder).embeddings.select("vec_id", "embedding"), "embedding", 1024, 100_000)
    return whitening.whiten(vectors, whitening.fit(vectors), ("vec_id",))


def op13_byte_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    file = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = rank_queue.encode(Tables(spark, folder).documents, file)
    digits = F.array_join(F.col("ids").cast("array<string>"), ",")
    digests = encoded.select("doc_id", "n_tokens", "ids", F.sha2(digits, 256).alias("ids_sha256"))
    decoded = rank_queue.decode(digests, file)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_importance_resampling,
        op3_bpe_round_trip,
        op4_preference_formatting,
        op5_benchmark_decontamination,
        op6_secret_scans,
        op7_quality_rules,
        op8_jaccard_join,
        jaccard_link_counts,
        op9_license_scans,
        op10_language_id,
        op11_periodic_runs,
        op12_embedding_whitening,
        op13_byte_bpe_round_trip,
    )
}

ORACLE_SQL: dict[str, str] = {k: ORACLES[k] for k in QUERIES if k in ORACLES}
