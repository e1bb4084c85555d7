"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from . import centroid_clustering, decontaminate, exact_dedup, html_extract, jaccard_join, language_id, lm_score, mixing, quality_rules, secret_scan, toxicity, warc, whitening

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_jaccard_join": jaccard_join.op3_jaccard_join,
    "op4_lm_scoring": lm_score.op4_lm_scoring,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_decontamination": decontaminate.op6_decontamination,
    "op7_html_extraction": html_extract.op7_html_extraction,
    "op8_mixing": mixing.op8_mixing,
    "op9_secret_scan": secret_scan.op9_secret_scan,
    "op10_warc": warc.op10_warc,
    "op11_centroid_clustering": centroid_clustering.op11_centroid_clustering,
    "op12_whitening": whitening.op12_whitening,
    "op13_quality_rules": quality_rules.op13_quality_rules,
}
ORACLE_SQL = {
    "op2_exact_dedup": exact_dedup.SQL,
    "op3_jaccard_join": jaccard_join.SQL,
    "op4_lm_scoring": lm_score.SQL,
    "op10_warc": warc.SQL,
    "op11_centroid_clustering": centroid_clustering.SQL,
}
