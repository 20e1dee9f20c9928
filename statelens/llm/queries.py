"""The registered queries of this subpackage, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, embedding_dedup, language_id, license_scan, line_dedup, packing, quality, simhash, url_filter, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_embedding_near_dedup": embedding_dedup.query,
        "op2_decontamination": decontam.query,
        "op2_decontamination_near": decontam.near_query,
        "op3_quality": quality.query,
        "op4_warc_revisits": warc.query,
        "op5_language_id": language_id.query,
        "op6_simhash_near_dedup": simhash.query,
        "op7_line_dedup": line_dedup.query,
        "op8_packing": packing.query,
        "op9_license_scan": license_scan.query,
        "op10_url_filter": url_filter.query,
    }


def oracle_sql() -> dict[str, str]:
    """SQL that is fast enough over whole tables; the other operators are tested against brute force."""
    return {
        "op2_decontamination": decontam.ORACLE,
        "op4_warc_revisits": warc.ORACLE,
        "op7_line_dedup": line_dedup.ORACLE,
        "op9_license_scan": license_scan.oracle_sql(),
    }
