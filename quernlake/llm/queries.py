"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import decontam, exact_dedup, langid, line_dedup, mixing, near_dedup, secret_scan, suffix_dedup, token_output, toxicity

QUERIES = {
    "op9_secret_scan": secret_scan.op9_secret_scan,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op1_toxicity": toxicity.op1_toxicity,
    "op6_language_id": langid.op6_language_id,
    "op3_decontamination": decontam.op3_decontamination,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_mixing": mixing.op8_mixing,
    "op10_token_output": token_output.op10_token_output,
}
ORACLE_SQL = {
    "op3_decontamination": decontam.OP3_SQL,
    "op5_line_dedup": line_dedup.OP5_SQL,
    "op7_exact_dedup": exact_dedup.OP7_SQL,
    "op8_mixing": mixing.OP8_SQL,
}
