"""The corpus operators' queries by name, and SQL where SQL can express them."""

from __future__ import annotations

from . import ann, chat, chat_repair, line_dedup, matroska, mixing, packing, pii, secret_scan, simhash, substring_dedup, toxicity, whitening

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_matroska": matroska.op2_matroska,
    "op3_packing": packing.op3_packing,
    "op4_pii": pii.op4_pii,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_chat": chat.op6_chat,
    "op7_mixing": mixing.op7_mixing,
    "op8_ann": ann.op8_ann,
    "op9_simhash": simhash.op9_simhash,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
    "op11_whitening": whitening.op11_whitening,
    "op12_chat_repair": chat_repair.op12_chat_repair,
    "op13_secrets": secret_scan.op13_secrets,
}
ORACLES = {"op1_line_dedup": line_dedup.OP1_SQL, "op7_mixing": mixing.OP7_SQL, "op13_secrets": secret_scan.OP13_SQL}
