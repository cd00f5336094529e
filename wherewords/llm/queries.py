"""The registered queries of this subpackage, and SQL where it can tell the same."""

from __future__ import annotations

import corpus_pipeline
from wherewords.llm import decontaminate, exact_dedup, hard_negatives, jaccard_join, language_model, line_dedup, lsh_forest, packing, secret_scan, spelling, token_files, toxicity, url_filter

QUERIES = {
    "op1_secret_scan": secret_scan.op1_secret_scan,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_jaccard_join": jaccard_join.op4_jaccard_join,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_decontamination": decontaminate.op6_decontamination,
    "op7_language_model": language_model.op7_language_model,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_token_files": token_files.op9_token_files,
    "op10_packing": packing.op10_packing,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_lsh_forest": lsh_forest.op13_lsh_forest,
    "pipeline": corpus_pipeline.run,
}
SQL = {
    "op2_exact_dedup": exact_dedup.SQL,
    "op5_url_filter": url_filter.SQL,
    "op6_decontamination": decontaminate.SQL,
    "op8_line_dedup": line_dedup.SQL,
    "op12_hard_negatives": hard_negatives.SQL,
}
