"""Queries and oracle SQL of the training-data operators."""

from . import (bpe, chat, compression, divergence, exact_dedup, mixing, pii, prefix_trie, quality, simhash, token_store, topk,
               toxicity)

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_byte_bpe": bpe.op3_byte_bpe,
    "op4_chat_format": chat.op4_chat_format,
    "op5_simhash": simhash.op5_simhash,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_top_k": topk.op7_top_k,
    "op8_token_store": token_store.op8_token_store,
    "op9_quality": quality.op9_quality,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_compression": compression.op11_compression,
    "op12_divergence": divergence.op12_divergence,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}

ORACLES = {
    "op2_mix_sources": mixing.SQL,
    "op4_chat_format": chat.SQL,
    "op6_exact_dedup": exact_dedup.SQL,
    "op7_top_k": topk.SQL,
    "op12_divergence": divergence.SQL,
    "op13_prefix_trie": prefix_trie.SQL,
}
