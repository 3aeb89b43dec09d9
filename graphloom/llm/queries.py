"""The queries of this folder, and their SQL where SQL can express them."""

from __future__ import annotations

from graphloom.llm import cover_tree, line_dedup, minhash, mixing, packing, quality, repetition, sharding, token_counts, url_filters

QUERIES = {
    "op1_bradley_terry": quality.op1_bradley_terry,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_suffix_repetition": repetition.op3_suffix_repetition,
    "op4_multi_index_minhash": minhash.op4_multi_index_minhash,
    "op5_cover_tree_pairs": cover_tree.op5_cover_tree_pairs,
    "near_vectors_loose": cover_tree.near_vectors_loose,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_time_varying_mix": mixing.op7_time_varying_mix,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_temporal_url_list": url_filters.op9_temporal_url_list,
    "op10_virtual_slots": sharding.op10_virtual_slots,
}

ORACLE_SQL = {
    "op5_cover_tree_pairs": cover_tree.SQL,
    "near_vectors_loose": cover_tree.SQL_LOOSE,
    "op7_time_varying_mix": mixing.SQL,
    "op8_line_dedup": line_dedup.SQL,
    "op9_temporal_url_list": url_filters.SQL,
    "op10_virtual_slots": sharding.SQL,
}
