"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answergauge.llm import (
    edit_join, fill_middle, interpolation, latent_search, merkle, oracles, packing, pii, quality, range_join, repeats,
    simhash, token_counts, wrapper)
from answergauge.llm.base import fold
from answergauge.plans.registry import collector
from answergauge.sources.readers import read_table

QUERIES, query = collector()


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def op1_edit_join(spark: SparkSession, sf: str) -> DataFrame:
    return edit_join.join_lines(read_table(spark, sf, "documents"), short_lines=True)


@query()
def op2_interpolation(spark: SparkSession, sf: str) -> DataFrame:
    return interpolation.score(read_table(spark, sf, "documents"))


@query()
def op3_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf, "documents")).drop("fp")


@query()
def op4_latent_search(spark: SparkSession, sf: str) -> DataFrame:
    return latent_search.find_leaks(read_table(spark, sf, "documents"), read_table(spark, sf, "benchmark"),
                                    paraphrased=latent_search.PARAPHRASED)


@query()
def op5_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.classify(read_table(spark, sf, "documents"), read_table(spark, sf, "labels"))


@query()
def op6_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(read_table(spark, sf, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=2)


@query()
def op7_range_join(spark: SparkSession, sf: str) -> DataFrame:
    return range_join.near_vectors(read_table(spark, sf, "embeddings"))


@query()
def op8_repeats(spark: SparkSession, sf: str) -> DataFrame:
    return repeats.remove_repeats(read_table(spark, sf, "documents"))


@query()
def op9_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf, "documents"), tokenizer_file("piece_bpe_32k.model"))


@query()
def op10_pii(spark: SparkSession, sf: str) -> DataFrame:
    key = spark.conf.get("spark.answergauge.pii.key", "set spark.answergauge.pii.key to a secret")
    return pii.pseudonymise(read_table(spark, sf, "documents"), key)


@query(oracles.MERKLE)
def op11_merkle(spark: SparkSession, sf: str) -> DataFrame:
    """Tampering deletes the line feeds of every document whose id has an even crc32."""
    docs, columns = read_table(spark, sf, "documents"), ("doc_id", "source", "lang", "n_chars", "text")
    stripped = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    leaves = docs.select(
        "doc_id", "source", merkle.leaf_digest(*(F.col(c) for c in columns)).alias("leaf"),
        F.when(fold(F.col("doc_id"), 2) == 0, merkle.leaf_digest(*(F.col(c) for c in columns[:-1]), stripped))
        .alias("tampered"))
    proven = merkle.manifest(leaves, "source", "doc_id", "leaf")
    folded = proven.withColumn("folded_root", merkle.fold(F.coalesce("tampered", "leaf"), F.col("steps")))
    return folded.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("steps")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))


@query(oracles.FILL_MIDDLE)
def op12_fill_middle(spark: SparkSession, sf: str) -> DataFrame:
    return fill_middle.fill_middle(read_table(spark, sf, "documents"), with_text=False)


@query()
def op13_wrapper(spark: SparkSession, sf: str) -> DataFrame:
    return wrapper.main_text(read_table(spark, sf, "pages"))
