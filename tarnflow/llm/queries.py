"""Queries of the training-data operators, with DuckDB SQL where it can express them."""

from __future__ import annotations

from tarnflow.llm import embed_dedup, exact_dedup, html_extract, line_dedup, mix, ngram_join, pack, quality, shard, warc

QUERIES = {
    f.__name__: f
    for f in (
        html_extract.op1_consensus_paths,
        warc.op2_derivative_records,
        quality.op3_bradley_terry_quality,
        pack.op4_pack,
        line_dedup.op5_line_dedup,
        embed_dedup.op6_product_quantisation,
        ngram_join.op7_ngram_jaccard,
        mix.op8_mix_sources,
        shard.op9_hilbert_shards,
        exact_dedup.op10_exact_dedup,
    )
}

ORACLES = {
    "op5_line_dedup": line_dedup.ORACLE,
    "op6_product_quantisation": embed_dedup.ORACLE,
    "op7_ngram_jaccard": ngram_join.ORACLE,
    "op8_mix_sources": mix.ORACLE,
    "op10_exact_dedup": exact_dedup.ORACLE,
}
