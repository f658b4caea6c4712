"""From raw documents to token shards: each stage is one operator over all that the stage before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sensorlith.llm import decontaminate, jaccard, mixture, tokens, toxicity
from sensorlith.llm.frames import stored
from sensorlith.session import prepare, work_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5; the model learns from the labels outside the held-out fifth."""
    prepare(spark)
    return toxicity.keep_clean(docs, toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of 75 % common five-word shingles connect."""
    prepare(spark)
    return jaccard.keep_one_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    prepare(spark)
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix to the target weights takes them."""
    prepare(spark)
    return mixture.mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards of the mix, and what they hold of each document."""
    prepare(spark)
    folder = work_path(spark, "tokens")
    return tokens.read_documents(tokens.write_shards(docs, public_tokenizers.path("word_bpe_49k.json"), folder), folder)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("source_mixture", mix_sources),
    ("token_ids", write_tokens),
]

#: a trained classifier, pseudorandom permutations and a tokenizer: the tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        rows = stage(spark, rows, sf_dir)
        if number + 1 < len(STAGES):
            rows = stored(rows, f"stage-{name}")
    return rows
