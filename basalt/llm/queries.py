"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, exact_dedup, lines, mixing, near, quality, sharding, tokens, urls, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc_transactions": warc.query,
        "op2_exact_radix_dedup": exact_dedup.query,
        "op3_line_set_similarity": lines.query,
        "op4_elias_fano_tokens": tokens.query,
        "op5_url_association_rules": urls.query,
        "op6_quality_trees": quality.query,
        "op7_ngram_bayes_join": near.query,
        "op8_cube_mixing": mixing.query,
        "op9_stratified_interleave": sharding.query,
        "op10_prefix_decontamination": decontaminate.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc_transactions": warc.SQL,
        "op2_exact_radix_dedup": exact_dedup.SQL,
        "op7_ngram_bayes_join": near.SQL,
        "op10_prefix_decontamination": decontaminate.SQL,
    }
