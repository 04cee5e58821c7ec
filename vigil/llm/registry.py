"""The registered queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chunking, decontaminate, divergence, fixity, hamming, language, mixing, near_duplicates, pii, prefixes, sharding, suffixes, toxicity
from .common import table


def _on_documents(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_merkle_fixity": lambda spark, d: fixity.op1(table(spark, d, "pages")),
        "op2_mix_sources": _on_documents(mixing.op2),
        "op3_content_chunks": _on_documents(chunking.op3),
        "op4_jaccard_join": _on_documents(near_duplicates.op4),
        "op5_shard_best_fit": _on_documents(sharding.op5),
        "op6_suffix_dedup": _on_documents(suffixes.op6),
        "op7_hamming_top_k": lambda spark, d: hamming.op7(table(spark, d, "embeddings")),
        "op8_language_profiles": _on_documents(language.op8),
        "op9_toxicity_kneser_ney": lambda spark, d: toxicity.op9(table(spark, d, "documents"), table(spark, d, "labels")),
        "op10_decontaminate": lambda spark, d: decontaminate.op10(table(spark, d, "documents"), table(spark, d, "benchmark")),
        "op11_conversation_trie": lambda spark, d: prefixes.op11(table(spark, d, "conversations")),
        "op12_personal_data": _on_documents(pii.op12),
        "op13_source_divergence": _on_documents(divergence.op13),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_merkle_fixity": fixity.SQL, "op4_jaccard_join": near_duplicates.SQL, "op6_suffix_dedup": suffixes.SQL, "op7_hamming_top_k": hamming.SQL, "op10_decontaminate": decontaminate.SQL,
        "op11_conversation_trie": prefixes.SQL, "op12_personal_data": pii.SQL, "op13_source_divergence": divergence.SQL,
    }
