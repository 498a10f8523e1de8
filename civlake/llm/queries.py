"""The queries of the training-data operators, and their SQL where SQL can say the same."""

from civlake.llm import exact_dedup, language_id, lsh_forest, mixing, packing, quality, ranked_search, repeats, resampling, sentence_pieces, simhash_tree, spot_signatures, token_counts

QUERIES = {
    "op1_packed_ids": packing.op1_packed_ids,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_source_mix": mixing.op3_source_mix,
    "op4_repeats": repeats.op4_repeats,
    "op5_sentence_pieces": sentence_pieces.op5_sentence_pieces,
    "op6_language_id": language_id.op6_language_id,
    "op7_quality": quality.op7_quality,
    "op8_spot_fingerprints": spot_signatures.op8_spot_fingerprints,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_near_dedup": lsh_forest.op10_near_dedup,
    "op11_resample": resampling.op11_resample,
    "op12_lexical_search": ranked_search.op12_lexical_search,
    "op13_simhash": simhash_tree.op13_simhash,
}

ORACLE_SQL = {
    "op9_exact_dedup": exact_dedup.OP9_SQL,
    "op10_near_dedup": lsh_forest.OP10_SQL,
    "op11_resample": resampling.OP11_SQL,
    "op12_lexical_search": ranked_search.OP12_SQL,
}
