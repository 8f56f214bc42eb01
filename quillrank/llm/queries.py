"""The queries and SQL of this subpackage, for the driver's entry module."""

from __future__ import annotations

from quillrank.llm import bases, fingerprints, jaccard, language, licenses, mixing, neighbours, pieces, quality, recompression, repair, suffix_levels, trie, warc


def queries() -> dict:
    return {
        "op1_quality": quality.op1_quality,
        "op2_fingerprints": fingerprints.op2_fingerprints,
        "op3_language": language.op3_language,
        "op4_licenses": licenses.op4_licenses,
        "op5_suffix_levels": suffix_levels.op5_suffix_levels,
        "op6_jaccard": jaccard.op6_jaccard,
        "op7_warc": warc.op7_warc,
        "op8_pieces": pieces.op8_pieces,
        "op9_recompression": recompression.op9_recompression,
        "op10_mixing": mixing.op10_mixing,
        "base_quality": bases.base_quality,
        "base_licenses": bases.base_licenses,
        "edited_texts": bases.edited_texts,
        "op11_trie": trie.op11_trie,
        "op12_neighbours": neighbours.op12_neighbours,
        "op13_repair": repair.op13_repair,
    }


def oracle_sql() -> dict[str, str]:
    modules = {
        "op5_suffix_levels": suffix_levels,
        "op6_jaccard": jaccard,
        "op7_warc": warc,
        "op9_recompression": recompression,
        "op10_mixing": mixing,
        "op11_trie": trie,
        "op12_neighbours": neighbours,
    }
    return {name: module.SQL for name, module in modules.items()} | bases.SQL
