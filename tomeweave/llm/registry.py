"""Queries and DuckDB SQL of the training-data operators."""

from tomeweave.llm import queries_bpe, queries_divergence, queries_language, queries_mixing, queries_near_dup, queries_ngram_join, queries_passages, queries_quality, queries_runs, queries_secrets, queries_tokenfiles, queries_topk, queries_urls

QUERIES = {
    "op1_bpe_round_trip": queries_bpe.op1_bpe_round_trip,
    "op2_near_duplicates": queries_near_dup.op2_near_duplicates,
    "op3_token_files": queries_tokenfiles.op3_token_files,
    "op4_drop_repeats": queries_passages.op4_drop_repeats,
    "op5_mix_sources": queries_mixing.op5_mix_sources,
    "op6_language_id": queries_language.op6_language_id,
    "op7_exact_topk": queries_topk.op7_exact_topk,
    "op8_url_filter": queries_urls.op8_url_filter,
    "op9_secret_scan": queries_secrets.op9_secret_scan,
    "op10_quality_rules": queries_quality.op10_quality_rules,
    "op11_source_divergence": queries_divergence.op11_source_divergence,
    "op12_periodic_runs": queries_runs.op12_periodic_runs,
    "op13_ngram_jaccard_join": queries_ngram_join.op13_ngram_jaccard_join,
}
ORACLE_SQL = {
    "op2_near_duplicates": queries_near_dup.SQL,
    "op5_mix_sources": queries_mixing.SQL,
    "op7_exact_topk": queries_topk.SQL,
    "op8_url_filter": queries_urls.SQL,
    "op9_secret_scan": queries_secrets.SQL,
    "op10_quality_rules": queries_quality.SQL,
    "op11_source_divergence": queries_divergence.SQL,
    "op13_ngram_jaccard_join": queries_ngram_join.SQL,
}
