"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from . import centroids, codes, decontaminate, jaccard, minmax, neighbours, quality, sentence_pieces, shards, substrings, token_counts, token_files, url_filters

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_token_files": token_files.op2_token_files,
    "op3_shards": shards.op3_shards,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_url_filters": url_filters.op5_url_filters,
    "op6_substring_dedup": substrings.op6_substring_dedup,
    "op7_quality": quality.op7_quality,
    "op8_neighbours": neighbours.op8_neighbours,
    "op9_jaccard_join": jaccard.op9_jaccard_join,
    "op10_sentence_pieces": sentence_pieces.op10_sentence_pieces,
    "op11_minmax": minmax.op11_minmax,
    "op12_codes": codes.op12_codes,
    "op13_centroids": centroids.op13_centroids,
}

ORACLES = {
    "op1_decontaminate": decontaminate.ORACLE,
    "op3_shards": shards.ORACLE,
    "op5_url_filters": url_filters.ORACLE,
    "op6_substring_dedup": substrings.ORACLE,
    "op9_jaccard_join": jaccard.ORACLE,
    "op11_minmax": minmax.ORACLE,
    "op12_codes": codes.ORACLE,
    "op13_centroids": centroids.ORACLE,
}
