"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from . import ann, decontaminate, lm_scoring, minhash, packing, pii, suffix_dedup, token_counts, toxicity, warc

QUERIES = {
    "op1_packing": packing.query,
    "op2_pii": pii.query,
    "op3_warc": warc.query,
    "op4_decontamination": decontaminate.query,
    "op5_ann": ann.query,
    "op6_minhash": minhash.query,
    "op7_toxicity": toxicity.query,
    "op8_suffix_dedup": suffix_dedup.query,
    "op9_token_counts": token_counts.query,
    "op10_lm_scoring": lm_scoring.query,
}

ORACLES: dict[str, str] = {
    "op3_warc": warc.ORACLE,
    "op4_decontamination": decontaminate.ORACLE,
    "op8_suffix_dedup": suffix_dedup.ORACLE,
}
