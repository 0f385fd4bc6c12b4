"""Queries and oracle SQL of this subpackage."""

from __future__ import annotations

from . import ann, bpe, chat, decontaminate, html, jaccard, langid, lm, tokenstore, toxicity

QUERIES = {
    "op1_nearest_neighbours": ann.op1_nearest_neighbours,
    "op2_bpe": bpe.op2_bpe,
    "op3_lm_perplexity": lm.op3_lm_perplexity,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_token_store": tokenstore.op5_token_store,
    "op6_jaccard_join": jaccard.op6_jaccard_join,
    "op7_decontamination": decontaminate.op7_decontamination,
    "op8_language_id": langid.op8_language_id,
    "op9_chat_perspectives": chat.op9_chat_perspectives,
    "op10_html_extraction": html.op10_html_extraction,
}
ORACLE_SQL = {
    "op6_jaccard_join": jaccard.OP6_SQL,
    "op7_decontamination": decontaminate.OP7_SQL,
    "op9_chat_perspectives": chat.OP9_SQL,
}
