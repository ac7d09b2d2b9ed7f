"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import decontam, filter_audit, language_id, license_scan, ngram_join, periodic_runs, pii, quality_rules, secret_scan, sp_codec, substring_dedup, token_count, url_filter


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_benchmark_decontamination": decontam.op3_benchmark_decontamination,
    "op4_sentencepiece_codec": sp_codec.op4_sentencepiece_codec,
    "op5_secret_scan": secret_scan.op5_secret_scan,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_ngram_jaccard_join": ngram_join.op7_ngram_jaccard_join,
    "op8_pii": pii.op8_pii,
    "op9_token_counts": token_count.op9_token_counts,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_language_id": language_id.op11_language_id,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_filter_interaction_audit": filter_audit.op13_filter_interaction_audit,
    "pipeline": pipeline,
}

SQL = {
    "op1_license_scan": license_scan.op1_sql(),
    "op2_url_filter": url_filter.OP2_SQL,
    "op6_substring_dedup": substring_dedup.OP6_SQL,
    "op7_ngram_jaccard_join": ngram_join.OP7_SQL,
    "op10_quality_rules": quality_rules.OP10_SQL,
    "op12_periodic_runs": periodic_runs.OP12_SQL,
    "op13_filter_interaction_audit": filter_audit.OP13_SQL,
}
