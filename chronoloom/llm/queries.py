"""The registered query of each operator, and SQL where it can express one."""

from chronoloom.llm import (
    decontaminate,
    html_text,
    license_scan,
    line_dedup,
    packing,
    quality_rules,
    simhash_dedup,
    suffix_dedup,
    url_filter,
    warc,
)

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_simhash_near_dedup": simhash_dedup.op3_simhash_near_dedup,
    "op4_warc": warc.op4_warc,
    "op5_license_scan": license_scan.op5_license_scan,
    "op6_packing": packing.op6_packing,
    "op7_html_extraction": html_text.op7_html_extraction,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_benchmark_decontamination": decontaminate.op9_benchmark_decontamination,
    "op10_suffix_array_dedup": suffix_dedup.op10_suffix_array_dedup,
}

ORACLE_SQL = {
    "op2_quality_rules": quality_rules.ORACLE,
    "op4_warc": warc.ORACLE,
    "op5_license_scan": license_scan.ORACLE,
    "op8_url_filter": url_filter.ORACLE,
}
