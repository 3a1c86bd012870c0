"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from loomgraph.llm import chat, decontaminate, exact_dedup, jaccard, lsh_forest, merkle, pieces, prefix_trie, quality, sharding, toxicity, url_filter, warc

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_quality": quality.op5_quality,
    "op6_warc": warc.op6_warc,
    "op7_jaccard": jaccard.op7_jaccard,
    "op8_chat_format": chat.op8_chat_format,
    "op9_sharding": sharding.op9_sharding,
    "op10_pieces": pieces.op10_pieces,
    "op11_manifest": merkle.op11_manifest,
    "op12_minhash": lsh_forest.op12_minhash,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}
SQL = {
    "op1_url_filter": url_filter.OP1_SQL,
    "op3_exact_dedup": exact_dedup.OP3_SQL,
    "op6_warc": warc.OP6_SQL,
    "op4_decontaminate": decontaminate.OP4_SQL,
    "op8_chat_format": chat.OP8_SQL,
    "op11_manifest": merkle.OP11_SQL,
    "op13_prefix_trie": prefix_trie.OP13_SQL,
}
