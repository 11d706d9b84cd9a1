"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, centroids, chunk_dedup, host_rules, minhash_dedup, pfor_store, phrases, piece_bpe, quality_gam, source_mix, suffix_dedup, toxicity, url_templates


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_array_dedup": suffix_dedup.query,
        "op2_minhash_near_dedup": minhash_dedup.query,
        "op3_source_mix": source_mix.query,
        "op4_quality_gam": quality_gam.query,
        "op5_token_id_output": pfor_store.query,
        "op6_exact_dedup": chunk_dedup.query,
        "op7_url_templates": url_templates.query,
        "op8_toxicity": toxicity.query,
        "op9_host_rules": host_rules.query,
        "op10_byte_bpe": byte_bpe.query,
        "op11_phrase_collocations": phrases.query,
        "op12_centroid_clusters": centroids.query,
        "op13_piece_bpe": piece_bpe.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_minhash_near_dedup": minhash_dedup.SQL,
        "op3_source_mix": source_mix.SQL,
        "op6_exact_dedup": chunk_dedup.SQL,
        "op9_host_rules": host_rules.SQL,
        "op11_phrase_collocations": phrases.SQL,
        "op12_centroid_clusters": centroids.SQL,
    }
