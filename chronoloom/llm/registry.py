"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, chunks, decontaminate, jaccard, language, licenses, manifest, media, packing, secrets, sharding, token_files, vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_consistent_hash_shards": sharding.op1_consistent_hash_shards,
    "op2_bounded_space_packing": packing.op2_bounded_space_packing,
    "op3_jaccard_metric_join": jaccard.op3_jaccard_metric_join,
    "op4_ppm_language_id": language.op4_ppm_language_id,
    "op5_positional_license_scan": licenses.op5_positional_license_scan,
    "op6_forest_secret_scan": secrets.op6_forest_secret_scan,
    "op7_media_tar_shards": media.op7_media_tar_shards,
    "op8_substring_dedup": chunks.op8_substring_dedup,
    "op9_benchmark_decontamination": decontaminate.op9_benchmark_decontamination,
    "op10_perspective_rotation": chat.op10_perspective_rotation,
    "op11_filtering_lloyd_codes": vector_codes.op11_filtering_lloyd_codes,
    "op12_mixing_token_files": token_files.op12_mixing_token_files,
    "op13_broadcast_top_manifest": manifest.op13_broadcast_top_manifest,
}

SQL: dict[str, str] = {
    "op3_jaccard_metric_join": jaccard.SQL_OP3,
    "op5_positional_license_scan": licenses.SQL_OP5,
    "op10_perspective_rotation": chat.SQL_OP10,
    "op11_filtering_lloyd_codes": vector_codes.SQL_OP11,
    "op13_broadcast_top_manifest": manifest.SQL_OP13,
}
