"""Queries and oracle SQL of the text operators, by query name."""

from __future__ import annotations

from . import (chat, exact_dedup, html_text, minhash, mixing, packing, phrases, repair, secrets, simhash, suffix_dedup,
               toxicity, weighted_sampling)

QUERIES = {
    "op1_pack": packing.query,
    "op2_html_text": html_text.query,
    "op3_suffix_dedup": suffix_dedup.query,
    "op4_toxicity": toxicity.query,
    "op5_exact_dedup": exact_dedup.query,
    "op6_weighted_sampling": weighted_sampling.query,
    "op7_minhash_groups": minhash.query,
    "op8_chat_format": chat.query,
    "op9_secret_scan": secrets.query,
    "op10_mix_sources": mixing.query,
    "op11_simhash_golay": simhash.query,
    "op12_repair_chats": repair.query,
    "op13_phrases": phrases.query,
}

#: only where DuckDB can say the same over whole tables
ORACLE = {
    "op5_exact_dedup": exact_dedup.ORACLE,
    "op10_mix_sources": mixing.ORACLE,
    "op12_repair_chats": repair.ORACLE,
    "op13_phrases": phrases.ORACLE,
}
