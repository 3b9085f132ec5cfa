"""Registered queries of the llm operators and their SQL twins."""

from __future__ import annotations

from seriesframe.llm import (bpe, chat, decontam, jaccard_rtree, license_scan, lm_trie, periodic_runs, robust_quality,
                             secret_crf, toxicity_chain, url_cascade, warc, whitening)

QUERIES = {
    "op1_url_cascade": url_cascade.query,
    "op2_warc_segments": warc.query,
    "op3_license_compression": license_scan.query,
    "op4_secret_crf": secret_crf.query,
    "op5_bpe": bpe.query,
    "op6_decontam": decontam.query,
    "op7_robust_quality": robust_quality.query,
    "op8_chat_events": chat.query,
    "op9_jaccard_rtree": jaccard_rtree.query,
    "op10_toxicity_chain": toxicity_chain.query,
    "op11_periodic_runs": periodic_runs.query,
    "op12_lm_trie": lm_trie.query,
    "op13_whitening": whitening.query,
}
#: The others depend on models, hashing or compression; their tests hold them against brute force.
SQL = {
    "op1_url_cascade": url_cascade.SQL,
    "op2_warc_segments": warc.SQL,
    "op8_chat_events": chat.SQL,
}
