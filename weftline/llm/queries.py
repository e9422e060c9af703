"""The operators' queries over whole tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.llm.chunkdedup import repeated_chunks
from weftline.llm.decontam import contaminated
from weftline.llm.lmscore import score
from weftline.llm.minhash import near_duplicates
from weftline.llm.mixing import mix_sources, mix_sql
from weftline.llm.pii import pseudonyms
from weftline.llm.quality import keep_good
from weftline.llm.suffixdedup import repeated_passages
from weftline.llm.tokenbin import token_ids
from weftline.llm.warc import WARC_SQL, pages_by_warc
from weftline.session import table

#: Target weights of the mix; sources not named have weight 2.
MIX_WEIGHTS = {"src0": 10.0, "src1": 6.0, "src2": 3.0, "src3": 1.0}
MIX_DEFAULT = 2.0
MIX_SEED = 20
#: Key of the pseudonyms; a deployment sets its own secret.
PII_KEY = os.environ.get("WEFT_PII_KEY", "weftline example key").encode()
#: Folder of tokenizer files, the same on every worker.
TOKENIZERS = os.environ.get("WEFT_TOKENIZERS", "/opt/tokenizers")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), MIX_WEIGHTS, MIX_DEFAULT, seed=MIX_SEED)


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_by_warc(table(spark, sf_dir, "pages"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = keep_good(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), scores=True)
    return kept.drop("text")


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/piece_bpe_32k.model")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op8_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_chunks(table(spark, sf_dir, "documents"))


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def op10_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms(table(spark, sf_dir, "documents"), PII_KEY)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_minhash_dedup": op2_minhash_dedup,
    "op3_warc": op3_warc,
    "op4_quality_rules": op4_quality_rules,
    "op5_lm_score": op5_lm_score,
    "op6_decontaminate": op6_decontaminate,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_chunk_dedup": op8_chunk_dedup,
    "op9_token_ids": op9_token_ids,
    "op10_pii_pseudonyms": op10_pii_pseudonyms,
}
ORACLE: dict[str, str] = {
    "op1_mix_sources": mix_sql(MIX_WEIGHTS, MIX_DEFAULT, MIX_SEED),
    "op3_warc": WARC_SQL,
}
