"""Operators of a training-data pipeline and their registered queries."""

from . import exact_dedup, fill_in_middle, harmonic, language_id, lm_scoring, mixing, packing, quality_classifier, quality_rules, secrets, simhash, spelling, token_counts

QUERIES = {
    "op1_simhash": simhash.query,
    "op2_mixing": mixing.query,
    "op3_quality_rules": quality_rules.query,
    "op4_lm_scoring": lm_scoring.query,
    "op5_language_id": language_id.query,
    "op6_best_fit_packing": packing.query,
    "op7_secret_scans": secrets.query,
    "op8_token_counts": token_counts.query,
    "op9_quality_classifier": quality_classifier.query,
    "op10_exact_dedup": exact_dedup.query,
    "op11_spelling_variants": spelling.query,
    "op12_fill_in_middle": fill_in_middle.query,
    "op13_harmonic_packing": harmonic.query,
}
ORACLES = {
    "op2_mixing": mixing.ORACLE_SQL,
    "op3_quality_rules": quality_rules.ORACLE_SQL,
    "op10_exact_dedup": exact_dedup.ORACLE_SQL,
    "op12_fill_in_middle": fill_in_middle.ORACLE_SQL,
}
