"""The operators' queries and their DuckDB SQL, as __spark_entry__ registers them."""

from __future__ import annotations

from . import ball_kmeans, exact_dedup, hard_negatives, main_text, mixing, near_dup, pii, quality, sentencepiece_codec, token_counts, token_output, toxicity, voronoi_knn

QUERIES = {
    "op1_quality": quality.op1,
    "op2_near_dup": near_dup.op2,
    "op3_token_output": token_output.op3,
    "op4_voronoi_knn": voronoi_knn.op4,
    "op5_toxicity": toxicity.op5,
    "op6_exact_dedup": exact_dedup.op6,
    "op7_pii": pii.op7,
    "op8_sentencepiece": sentencepiece_codec.op8,
    "op9_mixing": mixing.op9,
    "op10_token_counts": token_counts.op10,
    "op11_ball_kmeans": ball_kmeans.op11,
    "op12_main_text": main_text.op12,
    "op13_hard_negatives": hard_negatives.op13,
}

ORACLES = {
    "op4_voronoi_knn": voronoi_knn.OP4_SQL,
    "op6_exact_dedup": exact_dedup.OP6_SQL,
    "op9_mixing": mixing.oracle(),
    "op11_ball_kmeans": ball_kmeans.oracle(),
    "op12_main_text": main_text.op12,
    "op13_hard_negatives": hard_negatives.OP13_SQL,
}
