"""Queries of the training-data operators and the SQL that gives the same rows."""

from __future__ import annotations

from quillon.llm import op1_licenses, op2_katz, op3_simhash, op4_substrings, op5_chat, op6_decontaminate, op7_langid, op8_search, op9_tokens, op10_mix, op11_warc, op12_clusters, op13_repair

QUERIES = {
    "op1_license_scan": op1_licenses.op1_license_scan,
    "op2_katz_scores": op2_katz.op2_katz_scores,
    "op3_simhash": op3_simhash.op3_simhash,
    "op4_substring_dedup": op4_substrings.op4_substring_dedup,
    "op5_chat_formatting": op5_chat.op5_chat_formatting,
    "op6_decontamination": op6_decontaminate.op6_decontamination,
    "op7_language_id": op7_langid.op7_language_id,
    "op8_bm25_search": op8_search.op8_bm25_search,
    "op9_token_counts": op9_tokens.op9_token_counts,
    "op10_mix": op10_mix.op10_mix,
    "op11_warc": op11_warc.op11_warc,
    "op12_clusters": op12_clusters.op12_clusters,
    "op13_repair": op13_repair.op13_repair,
}

ORACLES = {
    "op4_substring_dedup": op4_substrings.ORACLE,
    "op5_chat_formatting": op5_chat.ORACLE,
    "op8_bm25_search": op8_search.ORACLE,
    "op10_mix": op10_mix.ORACLE,
    "op11_warc": op11_warc.ORACLE,
    "op12_clusters": op12_clusters.ORACLE,
    "op13_repair": op13_repair.ORACLE,
}
