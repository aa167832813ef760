"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import collocations, decontamination, html_extraction, line_dedup, mixing, ngram_join, quality_classifier, quality_rules, secret_scans, spelling, token_counts, url_filters, warc

MODULES = {
    "op1_ngram_join": ngram_join,
    "op2_url_filters": url_filters,
    "op3_html_extraction": html_extraction,
    "op4_token_counts": token_counts,
    "op5_secret_scans": secret_scans,
    "op6_decontamination": decontamination,
    "op7_warc": warc,
    "op8_quality_classifier": quality_classifier,
    "op9_mixing": mixing,
    "op10_quality_rules": quality_rules,
    "op11_line_dedup": line_dedup,
    "op12_spelling_variants": spelling,
    "op13_collocations": collocations,
}


def queries() -> dict:
    return {name: m.query for name, m in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: m.SQL for name, m in MODULES.items() if getattr(m, "SQL", None)}
