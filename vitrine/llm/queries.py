"""Registered queries of the training-data operators, and their DuckDB SQL
where SQL can state the result."""

from __future__ import annotations

from vitrine.llm import (decontaminate, exact_dedup, language_id, license_scan, line_dedup, ngram_lm, periodic_runs,
                         simhash, token_output, unigram_pieces, url_filter, vector_dedup, whitening)

QUERIES = {
    "op1_decontaminate": decontaminate.query,
    "op2_simhash": simhash.query,
    "op3_license_scan": license_scan.query,
    "op4_ngram_lm": ngram_lm.query,
    "op5_token_output": token_output.query,
    "op6_line_dedup": line_dedup.query,
    "op7_language_id": language_id.query,
    "op8_unigram_pieces": unigram_pieces.query,
    "op9_url_filters": url_filter.query,
    "op10_exact_dedup": exact_dedup.query,
    "op11_whitening": whitening.query,
    "op12_periodic_runs": periodic_runs.query,
    "op13_vector_dedup": vector_dedup.query,
}

ORACLE = {
    "op6_line_dedup": line_dedup.SQL,
    "op9_url_filters": url_filter.SQL,
    "op10_exact_dedup": exact_dedup.SQL,
}
