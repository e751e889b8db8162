"""The queries of this package, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from spindle.llm import ann, bpe, chat, maxent, packing, quality, simhash, tokens, toxicity, warc

QUERIES = {
    "op1_bpe": bpe.query,
    "op2_warc": warc.query,
    "op3_token_counts": tokens.query,
    "op4_toxicity": toxicity.query,
    "op5_simhash": simhash.query,
    "op6_maxent_lm": maxent.query,
    "op7_quality_rules": quality.query,
    "op8_chat_format": chat.query,
    "op9_ann": ann.query,
    "op10_best_fit_packing": packing.query,
}

ORACLE_SQL = {
    "op2_warc": warc.ORACLE,
    "op7_quality_rules": quality.oracle(),
    "op8_chat_format": chat.ORACLE,
}
