"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from spanforge.llm import conversation_trie, exact_dedup, jaccard_join, keyed_upsert, mixing, mpeg_audio, packing, pii, quality, repeats, secrets, sum_of_squares, toxicity

QUERIES = {
    "op1_jaccard_join": jaccard_join.op1_jaccard_join,
    "op2_quality": quality.op2_quality,
    "op3_secrets": secrets.op3_secrets,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_retrieval_packing": packing.op6_retrieval_packing,
    "op7_pii": pii.op7_pii,
    "op8_mpeg_audio": mpeg_audio.op8_mpeg_audio,
    "op10_repeats": repeats.op10_repeats,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op11_best_fit_packing": sum_of_squares.op11_best_fit_packing,
    "op12_conversation_trie": conversation_trie.op12_conversation_trie,
    "op13_keyed_upsert": keyed_upsert.op13_keyed_upsert,
}
ORACLES = {
    "op12_conversation_trie": conversation_trie.ORACLE,
    "op5_mix_sources": mixing.ORACLE,
    "op9_exact_dedup": exact_dedup.ORACLE,
}
