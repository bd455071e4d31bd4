"""Queries of this subpackage, and their SQL where SQL can express them."""

from assaylake.llm import bwt_dedup, decontamination, language_id, mixing, ngram_join, prefix_trie, progressive_jpeg, ranked_search, sharding, simhash, substring_dedup, token_files, toxicity

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_progressive_jpeg": progressive_jpeg.op2_progressive_jpeg,
    "op3_token_files": token_files.op3_token_files,
    "op7_decontamination": decontamination.op7_decontamination,
    "op8_toxicity": toxicity.op8_toxicity,
    "op5_simhash": simhash.op5_simhash,
    "op6_mixing": mixing.op6_mixing,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op4_bwt_dedup": bwt_dedup.op4_bwt_dedup,
    "op10_sharding": sharding.op10_sharding,
    "op11_ngram_join": ngram_join.op11_ngram_join,
    "op12_ranked_search": ranked_search.op12_ranked_search,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}
ORACLE_SQL = {"op6_mixing": mixing.op6_sql(), "op10_sharding": sharding.op10_sql(), "op12_ranked_search": ranked_search.op12_sql(), "op13_prefix_trie": prefix_trie.op13_sql()}
