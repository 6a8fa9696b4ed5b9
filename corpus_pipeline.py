"""A training corpus from `documents`: each stage is one of the operators, written and read again.

Stages take (spark, docs, sf_dir) and return a DataFrame: the columns of documents, but for the last,
which adds the token ids. docs is what the stage before kept, all of it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, language, simhash, suffix
from tessera.llm._common import free_name, stored

RANKS = "byte_bpe_multi_50k.tiktoken"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null texts, no letter) go; lang becomes what the network reads in the text."""
    return language.keep_known(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, that with the least doc_id."""
    return simhash.keep_one(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words that another document holds too go from both; n_chars follows.

    Words are compared, so other line breaks or indents don't hide a passage, and it goes wherever it
    stands: whose it was first can't be told, and no copy is kept. What repeats within one document only
    isn't this stage's matter. A document all of whose text goes, goes as well.
    """
    return suffix.without_repeats(docs, length=None, words=suffix.RUN_WORDS)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold four fifths of a benchmark item's five-word shingles go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add ids (packed, 32-bit little-endian), n_tokens and round_trip, whether they decode to the text; columns so named are replaced."""
    decoded = free_name("_decoded", docs)
    out = bpe.tokenize(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, decoded=decoded)
    same = F.col(decoded) == F.coalesce("text", F.lit(""))
    return out.withColumns({"n_tokens": F.expr("cast(length(ids) div 4 as bigint)"), "round_trip": same}).drop(decoded)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", drop_repeats),
    ("benchmark_decontamination", drop_benchmark),
    ("byte_level_bpe", encode_tokens),
]

#: SQL can't express the network, the fingerprints or the tokenizer; a test does all stages in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents, each written to the shared folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
