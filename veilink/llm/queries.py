"""The corpus operators' queries and the SQL of those that SQL can express."""

from __future__ import annotations

from . import exact_dedup, line_dedup, near_dedup, packing, pii, secrets, topk, toxicity, warc, word_bpe

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_warc": warc.op2_warc,
    "op3_pii": pii.op3_pii,
    "op4_word_bpe": word_bpe.op4_word_bpe,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op6_secrets": secrets.op6_secrets,
    "op7_top_k": topk.op7_top_k,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
}
ORACLES = {
    "op2_warc": warc.SQL,
    "op5_near_dedup": near_dedup.SQL,
    "op7_top_k": topk.SQL,
    "op10_exact_dedup": exact_dedup.SQL,
}
