"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from . import bpe, exact_dedup, html_text, language_id, near_dedup, neighbours, packing, periodic_runs, quality, secrets, spelling, substring_dedup, toxicity

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_secret_scans": secrets.op3_secret_scans,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_bpe_encoding": bpe.op5_bpe_encoding,
    "op6_quality_classifier": quality.op6_quality_classifier,
    "op7_minhash_near_dedup": near_dedup.op7_minhash_near_dedup,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_language_id": language_id.op9_language_id,
    "op10_nearest_neighbours": neighbours.op10_nearest_neighbours,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_html_extraction": html_text.op12_html_extraction,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}

ORACLE_SQL = {
    "op1_substring_dedup": substring_dedup.ORACLE_SQL,
    "op3_secret_scans": secrets.ORACLE_SQL,
    "op7_minhash_near_dedup": near_dedup.ORACLE_SQL,
    "op8_exact_dedup": exact_dedup.ORACLE_SQL,
    "op11_periodic_runs": periodic_runs.ORACLE_SQL,
    "op13_spelling_variants": spelling.ORACLE_SQL,
}
