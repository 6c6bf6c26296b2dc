"""The operators' queries, and their SQL where SQL can state them."""

from __future__ import annotations

from protospark.llm import bpe, chat, jaccard_join, language, licences, mixing, neighbours, quality, runs, spelling, substring_dedup, toxicity, urls

QUERIES = {
    "op1_neighbours": neighbours.op1_neighbours,
    "op2_bpe": bpe.op2_bpe,
    "op3_mixing": mixing.op3_mixing,
    "op4_jaccard_join": jaccard_join.op4_jaccard_join,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_licences": licences.op6_licences,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_chat_formatting": chat.op8_chat_formatting,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_language_id": language.op10_language_id,
    "op11_url_filters": urls.op11_url_filters,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_periodic_runs": runs.op13_periodic_runs,
}

ORACLE_SQL = {
    "op3_mixing": mixing.OP3_SQL,
    "op4_jaccard_join": jaccard_join.OP4_SQL,
    "op6_licences": licences.OP6_SQL,
    "op8_chat_formatting": chat.OP8_SQL,
    "op9_substring_dedup": substring_dedup.OP9_SQL,
    "op11_url_filters": urls.OP11_SQL,
    "op12_spelling_variants": spelling.OP12_SQL,
    "op13_periodic_runs": runs.OP13_SQL,
}
