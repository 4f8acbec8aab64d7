"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, counts, idfile, mixing, near, quality, substring, toxicity, warc
from ._shared import table


def tokenizer(name: str) -> str:
    """A tokenizer file in the folder named by PIXELWEAVE_TOKENIZERS, or in the installed package of public tokenizers."""
    if folder := os.environ.get("PIXELWEAVE_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.passages(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.roundtrip(table(spark, sf_dir, "pages"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    mixed = mixing.mix(docs)
    return mixed.select("doc_id", "source", "lang", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), "copies", "copy", "mix_key")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(bpe.encode(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json")))


def op7_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idfile.roundtrip(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op8_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.components(table(spark, sf_dir, "documents"), size=2, percent=80)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), keep=("doc_id", "source"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_substring_dedup, op2_toxicity, op3_warc, op4_quality_rules, op5_source_mixing, op6_bpe, op7_id_files, op8_nearest_vectors, op9_minhash_dedup, op10_token_counts)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": warc.oracle(), "op4_quality_rules": quality.oracle(), "op5_source_mixing": mixing.oracle(), "op8_nearest_vectors": ann.oracle()}
