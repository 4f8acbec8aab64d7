"""The corpus pipeline: stages over `documents`, each written as Parquet and reread as the next one's input.

Defined results: rows with a null doc_id, null or empty texts stay in every stage (mixing repeats or drops them like others); rows that share a doc_id
are rows each, those equal in doc_id and text are copies of which near_dedup keeps one; very long texts are taken whole; an empty table
gives an empty table; other columns, whatever their names, pass the stages unchanged, but for the last one, which returns digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.llm import bpe, mixing, near, queries, substring, toxicity
from pixelweave.llm._shared import cut, remove_all, table, written


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose toxicity score is 0.5 or more, by a model learned from the labels."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, name="toxicity score").where(F.col("toxicity score") < 0.5).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: 5-word shingles, similarity 0.8."""
    return near.keep_one(docs, size=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that repeat an earlier document out of the texts."""
    return substring.strip(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document by its source's rate, in a random order."""
    return mixing.mix(docs).select(docs.columns)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, whose decoding is compared with the text."""
    encoded = bpe.encode(docs, queries.tokenizer("byte_bpe_50k.json"))
    return bpe.digest(encoded)


STAGES = [
    ("toxicity", toxicity_filter),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("source_mixing", mix_sources),
    ("bpe", bpe_encode),
]

#: SQL can't express the stages; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage reads or wrote on its way is deleted once its own table is written."""
    docs, before = table(spark, sf_dir, "documents"), written()
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
        remove_all(spark, but=docs, since=before)
    return docs
