"""The registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from tallyshelf.llm import alignment, chunks, decontam, licenses, media, minmax, mixing, onebit, packing, quality, rollup, shards, spelling

QUERIES = {
    "op1_best_fit_packing": packing.op1,
    "op2_quality_classifier": quality.op2,
    "op3_media_signatures": media.op3,
    "op4_mix_sources": mixing.op4,
    "op5_one_bit_neighbours": onebit.op5,
    "op6_line_chunks": chunks.op6,
    "op7_minmax_near_duplicates": minmax.op7,
    "op8_license_scan": licenses.op8,
    "op9_token_rollup": rollup.op9,
    "op10_training_order_shards": shards.op10,
    "op11_spelling_variants": spelling.op11,
    "op12_token_alignment": alignment.op12,
    "op13_benchmark_decontamination": decontam.op13,
}

ORACLE_SQL: dict[str, str] = {
    "op4_mix_sources": mixing.OP4_SQL,
    "op11_spelling_variants": spelling.OP11_SQL,
    "op13_benchmark_decontamination": decontam.OP13_SQL,
}
