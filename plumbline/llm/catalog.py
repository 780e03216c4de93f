"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from plumbline.llm import decontaminate, knn, linededup, mixing, quality, secrets, simhash, tokenstore, toxicity, warc

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_decontamination": decontaminate.op2_decontamination,
    "op3_mixing": mixing.op3_mixing,
    "op4_quality": quality.op4_quality,
    "op5_line_dedup": linededup.op5_line_dedup,
    "op7_simhash": simhash.op7_simhash,
    "op6_warc": warc.op6_warc,
    "op8_secrets": secrets.op8_secrets,
    "op9_knn": knn.op9_knn,
    "op10_token_store": tokenstore.op10_token_store,
}

ORACLE_SQL = {
    "op2_decontamination": decontaminate.OP2_SQL,
    "op3_mixing": mixing.OP3_SQL,
    "op5_line_dedup": linededup.OP5_SQL,
    "op9_knn": knn.OP9_SQL,
}
