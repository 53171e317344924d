"""The subpackage's registered queries and their SQL."""

from . import arc_to_warc, exact_dedup, jaccard_join, language_id, line_crf, mixing, packing, quality_rules, secret_scan, site_template

QUERIES = {
    "op1_best_fit_packing": packing.query,
    "op2_source_mixing": mixing.query,
    "op3_arc_to_warc": arc_to_warc.query,
    "op4_quality_rules": quality_rules.query,
    "op5_secret_scan": secret_scan.query,
    "op6_language_id": language_id.query,
    "op7_ngram_jaccard_join": jaccard_join.query,
    "op8_exact_dedup": exact_dedup.query,
    "op9_line_crf": line_crf.query,
    "op10_site_template": site_template.query,
}

ORACLES = {
    "op2_source_mixing": mixing.SQL,
    "op3_arc_to_warc": arc_to_warc.SQL,
    "op7_ngram_jaccard_join": jaccard_join.SQL,
    "op8_exact_dedup": exact_dedup.SQL,
}
