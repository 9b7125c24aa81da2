"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import jaccard, leaks, licenses, mixing, names, pieces, pii, quality, repeats, toxicity, trie, vectors


def queries() -> dict:
    return {
        "op1_ngram_jaccard": jaccard.op1,
        "op2_toxicity": toxicity.op2,
        "op3_embedding_neardup": vectors.op3,
        "op4_suffix_dedup": repeats.op4,
        "op5_quality": quality.op5,
        "op6_sentencepiece": pieces.op6,
        "op7_pii": pii.op7,
        "op8_mixing": mixing.op8,
        "op9_topk": vectors.op9,
        "op10_licenses": licenses.op10,
        "op11_prefix_trie": trie.op11,
        "op12_name_join": names.op12,
        "op13_decontaminate": leaks.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard": jaccard.ORACLE, "op3_embedding_neardup": vectors.ORACLE_LINKS, "op4_suffix_dedup": repeats.ORACLE, "op7_pii": pii.ORACLE, "op9_topk": vectors.ORACLE_TOP, "op11_prefix_trie": trie.ORACLE, "op12_name_join": names.ORACLE, "op13_decontaminate": leaks.ORACLE}
