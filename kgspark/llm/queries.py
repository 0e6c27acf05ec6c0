"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from kgspark.llm import conversation_trie, embedding_dedup, fingerprints, html_extraction, lexical_search, licenses, mixing, ngram_join, packing, quality, secrets, tokens, url_filter

QUERIES = {
    "op1_document_fingerprints": fingerprints.op1_document_fingerprints,
    "op2_html_extraction": html_extraction.op2_html_extraction,
    "op3_ngram_jaccard_join": ngram_join.op3_ngram_jaccard_join,
    "op4_secret_scans": secrets.op4_secret_scans,
    "op5_license_scans": licenses.op5_license_scans,
    "op6_embedding_near_dedup": embedding_dedup.op6_embedding_near_dedup,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_quality_classifier": quality.op8_quality_classifier,
    "op9_token_ids": tokens.op9_token_ids,
    "op10_mixing_sources": mixing.op10_mixing_sources,
    "op11_ranked_lexical_search": lexical_search.op11_ranked_lexical_search,
    "op12_url_filters": url_filter.op12_url_filters,
    "op13_conversation_prefix_trie": conversation_trie.op13_conversation_prefix_trie,
}

ORACLES = {
    "op1_document_fingerprints": fingerprints.SQL,
    "op4_secret_scans": secrets.SQL,
    "op5_license_scans": licenses.SQL,
    "op10_mixing_sources": mixing.SQL,
    "op11_ranked_lexical_search": lexical_search.SQL,
    "op12_url_filters": url_filter.SQL,
    "op13_conversation_prefix_trie": conversation_trie.SQL,
}
