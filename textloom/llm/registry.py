"""The subpackage's queries and their SQL."""

from __future__ import annotations

import corpus_pipeline
from textloom.llm import byte_bpe, decontaminate, exact_dedup, html_extract, near_dedup, packing, quality_knn, repeated_spans, secret_scan, source_audit, spelling, token_file, warc_zip


def queries() -> dict:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_html_extraction": html_extract.query,
        "op2_repeated_spans": repeated_spans.query,
        "op3_warc_zip": warc_zip.query,
        "op4_best_fit_packing": packing.query,
        "op5_near_dedup": near_dedup.query,
        "op6_secret_scan": secret_scan.query,
        "op7_exact_dedup": exact_dedup.query,
        "op8_token_file": token_file.query,
        "op9_decontaminate": decontaminate.query,
        "op10_quality_knn": quality_knn.query,
        "op11_source_audit": source_audit.query,
        "op12_byte_bpe": byte_bpe.query,
        "op13_spelling_variants": spelling.query,
    }


def oracle_sql() -> dict:
    return {"op3_warc_zip": warc_zip.SQL, "op7_exact_dedup": exact_dedup.SQL, "op9_decontaminate": decontaminate.SQL, "op11_source_audit": source_audit.SQL, "op13_spelling_variants": spelling.SQL}
