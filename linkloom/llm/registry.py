"""Queries of the corpus operators and their DuckDB equivalents."""

from __future__ import annotations

from linkloom.llm import exact_dedup, licenses, media, near_dedup, packing, passages, pieces, quality, repeats, url_filter

QUERIES = {
    "op1_url_filter": url_filter.op1,
    "op2_packing": packing.op2,
    "op3_repeats": repeats.op3,
    "op4_near_dedup": near_dedup.op4,
    "op5_quality_classifier": quality.op5,
    "op6_licenses": licenses.op6,
    "op7_pieces": pieces.op7,
    "op8_passages": passages.op8,
    "op9_media_columns": media.op9,
    "op10_exact_dedup": exact_dedup.op10,
}
ORACLES = {
    "op6_licenses": licenses.ORACLE,
    "op10_exact_dedup": exact_dedup.ORACLE,
}
