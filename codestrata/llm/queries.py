"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontaminate, line_dedup, minhash, mixing, neighbours, notices, repeats, token_binary, token_counts, toxicity

QUERIES = {
    "op1_decontamination": decontaminate.op1_decontamination,
    "op2_token_binary": token_binary.op2_token_binary,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_suffix_dedup": repeats.op4_suffix_dedup,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_neighbours": neighbours.op6_neighbours,
    "op7_minhash": minhash.op7_minhash,
    "op8_mixing": mixing.op8_mixing,
    "op9_license_scan": notices.op9_license_scan,
    "op10_token_counts": token_counts.op10_token_counts,
}
ORACLES = {
    "op5_line_dedup": line_dedup.ORACLE,
    "op8_mixing": mixing.ORACLE,
}
