"""Registered queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

import corpus_pipeline
from lintlake.llm import (
    bit_codes, bloom_sketch, fm_index, induced_dedup, line_dedup, pfor, position_index, prefix_parse, pseudonyms, random_index, superkmers, tensor_minhash, vector_packing,
)

QUERIES = {
    "op1_pfor_tokens": pfor.query,
    "op2_fm_decontamination": fm_index.query,
    "op3_induced_suffix_dedup": induced_dedup.query,
    "op4_vector_packing": vector_packing.query,
    "op5_superkmer_dedup": superkmers.query,
    "op6_deletion_line_dedup": line_dedup.query,
    "op7_tensor_minhash": tensor_minhash.query,
    "op8_bloom_fingerprints": bloom_sketch.query,
    "op9_feistel_pseudonyms": pseudonyms.query,
    "op10_quality_network": random_index.query,
    "op11_position_index": position_index.query,
    "op12_prefix_parse": prefix_parse.query,
    "op13_bit_codes": bit_codes.query,
    "pipeline": corpus_pipeline.run,
}
ORACLE = {"op6_deletion_line_dedup": line_dedup.SQL, "op11_position_index": position_index.SQL, "op12_prefix_parse": prefix_parse.SQL}
