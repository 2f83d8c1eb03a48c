"""Queries of this package and the SQL that some of them must equal."""

from __future__ import annotations

from testsieve.llm import centroids, chat, decontam, fingerprints, lm_score, near_dup, packing, prefix_trie, quality, sharding, suffixes, token_counts, toxicity

QUERIES = {
    "op1_lm_score": lm_score.op1_lm_score,
    "op2_decontamination": decontam.op2_decontamination,
    "op3_packing": packing.op3_packing,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_chat": chat.op6_chat,
    "op7_near_duplicates": near_dup.op7_near_duplicates,
    "op8_quality": quality.op8_quality,
    "op9_fingerprints": fingerprints.op9_fingerprints,
    "op10_sharding": sharding.op10_sharding,
    "op11_centroids": centroids.op11_centroids,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_suffix_dedup": suffixes.op13_suffix_dedup,
}

SQL: dict[str, str] = {
    "op2_decontamination": decontam.OP2_SQL,
    "op6_chat": chat.OP6_SQL,
    "op11_centroids": centroids.OP11_SQL,
    "op12_prefix_trie": prefix_trie.OP12_SQL,
    "op13_suffix_dedup": suffixes.OP13_SQL,
}
