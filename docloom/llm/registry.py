"""Queries of the llm operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from docloom.llm import decontam, jaccard, neighbours, pieces, quality, scoring, secrets, sharding, url_filter, warc

QUERIES = {
    "op1_lm_scoring": scoring.op1_lm_scoring,
    "op2_decontamination": decontam.op2_decontamination,
    "op3_quality": quality.op3_quality,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_secret_scan": secrets.op5_secret_scan,
    "op6_warc": warc.op6_warc,
    "op7_nearest_neighbours": neighbours.op7_nearest_neighbours,
    "op8_ngram_jaccard": jaccard.op8_ngram_jaccard,
    "op9_sharding": sharding.op9_sharding,
    "op10_sentencepiece": pieces.op10_sentencepiece,
}

ORACLES = {
    "op4_url_filter": url_filter.OP4_SQL,
    "op6_warc": warc.OP6_SQL,
}
