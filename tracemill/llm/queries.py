"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from tracemill.llm import chat, embedding_dedup, licenses, mixing, ngram_join, parsing, pieces, quality, token_counts, warc

QUERIES = {
    "op1_document_fingerprints": parsing.op1_document_fingerprints,
    "op2_warc": warc.op2_warc,
    "op3_quality_classifier": quality.op3_quality_classifier,
    "op4_license_scan": licenses.op4_license_scan,
    "op5_ngram_jaccard_join": ngram_join.op5_ngram_jaccard_join,
    "op6_chat_windows": chat.op6_chat_windows,
    "op7_source_mixing": mixing.op7_source_mixing,
    "op8_embedding_near_dedup": embedding_dedup.op8_embedding_near_dedup,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_sentencepiece": pieces.op10_sentencepiece,
}
ORACLES = {
    "op2_warc": warc.ORACLE,
    "op5_ngram_jaccard_join": ngram_join.ORACLE,
}
