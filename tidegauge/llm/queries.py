"""The queries of this subpackage by name, and the SQL that gives the same rows where there is one."""

from __future__ import annotations

from tidegauge.llm.alignment import op11_cross_tokenizer_alignment
from tidegauge.llm.decontamination import OP7_SQL, op7_benchmark_decontamination
from tidegauge.llm.language_id import op3_language_id
from tidegauge.llm.license_scan import op9_license_scan
from tidegauge.llm.line_dedup import OP10_SQL, op10_line_dedup
from tidegauge.llm.lm_scoring import op4_lm_scoring
from tidegauge.llm.media_columns import op6_media_columns
from tidegauge.llm.merkle import OP12_SQL, op12_merkle_manifest
from tidegauge.llm.packing import op5_best_fit_packing
from tidegauge.llm.simhash import op2_simhash_near_dedup
from tidegauge.llm.substring_dedup import OP1_SQL, op1_substring_dedup
from tidegauge.llm.token_counts import op8_token_counts
from tidegauge.llm.top_k import OP13_SQL, op13_exact_top_k

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op4_lm_scoring": op4_lm_scoring,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op8_token_counts": op8_token_counts,
    "op9_license_scan": op9_license_scan,
    "op3_language_id": op3_language_id,
    "op6_media_columns": op6_media_columns,
    "op10_line_dedup": op10_line_dedup,
    "op11_cross_tokenizer_alignment": op11_cross_tokenizer_alignment,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_exact_top_k": op13_exact_top_k,
}

ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": OP1_SQL,
    "op7_benchmark_decontamination": OP7_SQL,
    "op10_line_dedup": OP10_SQL,
    "op12_merkle_manifest": OP12_SQL,
    "op13_exact_top_k": OP13_SQL,
}
