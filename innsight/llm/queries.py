"""The operators over their whole tables, with production parameters, and SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from innsight.llm import alignment, chat, decontaminate, jaccard_join, language, licences, line_dedup, near_dup
from innsight.llm import packing, quality, repair, sharding, token_counts
from innsight.llm._work import shared_folder

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts through a cache that begins empty, so that the query encodes every distinct text itself."""
    documents = _read(spark, sf_dir, "documents")
    return token_counts.count_tokens(documents, tokenizer_path(), shared_folder(spark, "token-cache"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), tokenizer_path())


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = tokenizer_path("piece_bpe_32k.model")
    return alignment.align_tokenizers(_read(spark, sf_dir, "documents"), tokenizer_path(), pieces)


def queries() -> dict[str, Query]:
    return {
        "op1_token_counts": op1,
        "op2_chat_formatting": lambda s, d: chat.format_chats(_read(s, d, "conversations")),
        "op3_language_id": lambda s, d: language.identify(_read(s, d, "documents")),
        "op4_licence_scan": lambda s, d: licences.scan_licences(_read(s, d, "documents")),
        "op5_packing": op5,
        "op6_sharding": lambda s, d: sharding.shard_documents(_read(s, d, "documents")),
        "op7_quality_rules": lambda s, d: quality.clean_documents(_read(s, d, "documents"), with_text=False),
        "op8_decontamination": op8,
        "op9_near_duplicates": lambda s, d: near_dup.near_duplicates(_read(s, d, "documents")),
        "op10_line_dedup": lambda s, d: line_dedup.line_report(_read(s, d, "documents")),
        "op11_tokenizer_alignment": op11,
        "op12_conversation_repair": lambda s, d: repair.repair_conversations(_read(s, d, "conversations")),
        "op13_jaccard_join": lambda s, d: jaccard_join.join_documents(_read(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    from innsight.llm import oracles

    return oracles.all_oracles()
