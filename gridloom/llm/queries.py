"""Queries of the training-data operators and, where SQL can express them, their oracles."""

from __future__ import annotations

from gridloom.llm import chunk_dedup, decontaminate, html_template, language_ecoc, multiset_fingerprint, packing_lp, pii_surrogates, quality_pu, simhash_vptree, suffix_dedup

QUERIES = {
    "op1_chunk_dedup": chunk_dedup.op1,
    "op2_suffix_dedup": suffix_dedup.op2,
    "op3_packing_lp": packing_lp.op3,
    "op4_html_template": html_template.op4,
    "op5_quality_pu": quality_pu.op5,
    "op6_language_ecoc": language_ecoc.op6,
    "op7_multiset_fingerprint": multiset_fingerprint.op7,
    "op8_pii_surrogates": pii_surrogates.op8,
    "op9_simhash_vptree": simhash_vptree.op9,
    "op10_decontaminate": decontaminate.op10,
}

ORACLES: dict[str, str] = {
    "op10_decontaminate": decontaminate.ORACLE,
}
