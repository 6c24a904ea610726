"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from importlib import import_module

#: query name -> module of this subpackage that holds the function of that name
MODULES = {
    "op1_simhash_decontamination": "decontaminate",
    "op2_minhash_near_dups": "near_dups",
    "op3_interleaved_media": "media",
    "op4_recompression_dedup": "substrings",
    "op5_byte_bpe": "byte_bpe",
    "op6_block_labeller": "html_blocks",
    "op7_grammar_toxicity": "toxicity",
    "op8_weak_quality": "quality",
    "op9_context_mixing_ids": "id_files",
    "op10_temporal_url_lists": "url_lists",
    "op11_tiled_jaccard_join": "jaccard_join",
    "op12_laesa_vector_codes": "vector_codes",
    "op13_blockmatrix_whitening": "whitening",
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    from . import jaccard_join, url_lists, vector_codes

    return {"op10_temporal_url_lists": url_lists.ORACLE_SQL, "op11_tiled_jaccard_join": jaccard_join.ORACLE_SQL, "op12_laesa_vector_codes": vector_codes.ORACLE_SQL}
