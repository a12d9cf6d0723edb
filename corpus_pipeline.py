"""A training corpus from ``documents`` in five stages, each a DataFrame to a DataFrame.

Each stage gets what its predecessor kept and returns the columns of ``documents`` (the last one: the encoded corpus).
Rows are decided where they lie; only the near-duplicate stage moves data, and of it only what its join needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabloom.llm import bpe, decontaminate, jaccard_join, language, toxicity
from tabloom.llm.queries import vocabulary
from tabloom.sources.runtime import materialize

#: Words of a shingle and least Jaccard similarity in per cent of near duplicates; ``op8_jaccard_join`` has its own.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, with that language as their ``lang``; null texts and texts without a letter go."""
    model = language.train(docs.where(language.fold("doc_id", 4) != 2))
    return language.keep_identified(docs, model)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; learned from the labels of what came here.

    The language that the stage before has told decides whose threshold a document is held against.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels.where(language.fold("doc_id", 5) != 0))
    return toxicity.keep_harmless(docs, model, lang="lang")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of documents alike in at least 80 % of their five-word shingles the one with the smallest id."""
    return jaccard_join.keep_one(docs, size=NEAR_WORDS, percent=NEAR_PERCENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which fewer than one word in twenty is copied from a benchmark item."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and whether the ids decode to the text again."""
    import public_tokenizers

    return bpe.encode_checked(docs, vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", identify_language),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode_tokens),
]

#: SQL cannot state the trained stages; ``tests/llm`` holds the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    encoded = STAGES[-1][1](spark, docs, sf_dir)
    return encoded.select("doc_id", "n_tokens", F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_digest"), "decodes")
