"""From documents to token ids: quality rules, near-dedup, decontamination, mixing, binary output.

Each stage works on all rows its predecessor kept and, but for the last,
returns the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.llm._shared import new_folder
from weftline.llm.decontam import decontaminated
from weftline.llm.minhash import keep_first
from weftline.llm.mixing import mix_sources
from weftline.llm.quality import keep_good
from weftline.llm.queries import MIX_DEFAULT, MIX_SEED, MIX_WEIGHTS, TOKENIZERS
from weftline.llm.tokenbin import token_ids
from weftline.session import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "labels"))


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources(docs, MIX_WEIGHTS, MIX_DEFAULT, seed=MIX_SEED, copy_col=None)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_ids(docs, f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("minhash_dedup", minhash_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix),
    ("token_ids", tokenize),
]
#: The signatures of near-dedup and the tokenizer's merges are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each but the last returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        at = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return STAGES[-1][1](spark, docs, sf_dir)
