"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, chat, collocations, fingerprints, lm, mixing, ngram_join, pii, prefix_trie, quality, sharding, toxicity, url_filter


def queries():
    return {
        "op1_mix_sources": mixing.op1_mix_sources,
        "op2_pii": pii.op2_pii,
        "op3_ngram_join": ngram_join.op3_ngram_join,
        "op4_lm_scores": lm.op4_lm_scores,
        "op5_fingerprints": fingerprints.op5_fingerprints,
        "op6_bpe": bpe.op6_bpe,
        "op7_url_filter": url_filter.op7_url_filter,
        "op8_quality": quality.op8_quality,
        "op9_chat": chat.op9_chat,
        "op10_toxicity": toxicity.op10_toxicity,
        "op11_collocations": collocations.op11_collocations,
        "op12_sharding": sharding.op12_sharding,
        "op13_prefix_trie": prefix_trie.op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": mixing.OP1_SQL, "op9_chat": chat.OP9_SQL, "op11_collocations": collocations.OP11_SQL, "op12_sharding": sharding.OP12_SQL, "op13_prefix_trie": prefix_trie.OP13_SQL}
