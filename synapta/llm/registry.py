"""Queries of this subpackage by name, and their DuckDB SQL where SQL can express them."""

from synapta.llm import chat_format, decontaminate, ngram_join, packing, prefix_trie, quality_classifier, quality_rules, substring_dedup, token_counts, token_files, toxicity, turn_repair, url_filter

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_token_files": token_files.op3_token_files,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_quality_classifier": quality_classifier.op5_quality_classifier,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_packing": packing.op7_packing,
    "op8_chat_format": chat_format.op8_chat_format,
    "op9_decontamination": decontaminate.op9_decontamination,
    "op10_ngram_join": ngram_join.op10_ngram_join,
    "op11_url_filter": url_filter.op11_url_filter,
    "op12_conversation_repair": turn_repair.op12_conversation_repair,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}

ORACLES = {
    "op1_quality_rules": quality_rules.ORACLE,
    "op2_substring_dedup": substring_dedup.ORACLE,
    "op8_chat_format": chat_format.ORACLE,
    "op9_decontamination": decontaminate.ORACLE,
    "op10_ngram_join": ngram_join.ORACLE,
    "op12_conversation_repair": turn_repair.ORACLE,
    "op13_prefix_trie": prefix_trie.ORACLE,
}
