"""The training-data operators' queries and their SQL."""

from . import decontamination, passages, pieces, secrets, sharding, simhash, substrings, tokens, topk, toxicity

QUERIES = {
    "op1_substring_dedup": substrings.query,
    "op2_decontamination": decontamination.query,
    "op3_exact_top_k": topk.query,
    "op4_secret_scan": secrets.query,
    "op5_token_files": tokens.query,
    "op6_simhash": simhash.query,
    "op7_toxicity": toxicity.query,
    "op8_sharding": sharding.query,
    "op9_passage_dedup": passages.query,
    "op10_pieces": pieces.query,
}

ORACLE_SQL = {
    "op1_substring_dedup": substrings.SQL,
    "op2_decontamination": decontamination.SQL,
    "op3_exact_top_k": topk.SQL,
    "op9_passage_dedup": passages.SQL,
}
