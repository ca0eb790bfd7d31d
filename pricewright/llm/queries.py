"""Registered queries of this package, with their SQL where SQL can express them."""

from __future__ import annotations

from . import chat_format, collocations, decontaminate, exact_topk, fertility, language_id, line_dedup, mixing, ngram_join, periodic_runs, pii_surrogates, secret_scan, token_store

QUERIES = {
    "op1_ngram_join": ngram_join.query,
    "op2_language_id": language_id.query,
    "op3_chat_format": chat_format.query,
    "op4_pii_surrogates": pii_surrogates.query,
    "op5_fertility": fertility.query,
    "op6_mixing": mixing.query,
    "op7_line_dedup": line_dedup.query,
    "op8_token_store": token_store.query,
    "op9_decontaminate": decontaminate.query,
    "op10_secret_scan": secret_scan.query,
    "op11_collocations": collocations.query,
    "op12_periodic_runs": periodic_runs.query,
    "op13_exact_topk": exact_topk.query,
}
SQL = {
    "op3_chat_format": chat_format.SQL,
    "op6_mixing": mixing.SQL,
    "op7_line_dedup": line_dedup.SQL,
    "op9_decontaminate": decontaminate.SQL,
    "op11_collocations": collocations.SQL,
    "op13_exact_topk": exact_topk.SQL,
}
