"""The queries of this subpackage and their DuckDB oracles."""

from . import decontaminate, divergence, exact_dedup, hard_negatives, license_scan, mixing, packing, secret_scan, simhash, substring_dedup, toxicity, url_filter, warc

QUERIES = {
    "op1_decontamination": decontaminate.op1_decontamination,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_simhash_near_dedup": simhash.op5_simhash_near_dedup,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_warc": warc.op7_warc,
    "op8_license_scan": license_scan.op8_license_scan,
    "op9_secret_scan": secret_scan.op9_secret_scan,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_source_mixing": mixing.op13_source_mixing,
}

#: Left out where SQL can't express the operator; tests/llm holds those against brute force.
ORACLE_SQL = {
    "op1_decontamination": decontaminate.SQL,
    "op3_substring_dedup": substring_dedup.SQL,
    "op4_url_filter": url_filter.SQL,
    "op7_warc": warc.SQL,
    "op8_license_scan": license_scan.SQL,
    "op9_secret_scan": secret_scan.SQL,
    "op10_exact_dedup": exact_dedup.SQL,
    "op11_hard_negatives": hard_negatives.SQL,
    "op12_source_divergence": divergence.SQL,
    "op13_source_mixing": mixing.SQL,
}
