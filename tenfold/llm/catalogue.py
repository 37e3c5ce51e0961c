"""Queries of the training-data operators by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from tenfold.llm import anchors, avi, bitsliced, bpe, lines, packing, rans, suffixes, toxicity, weighted_minhash

QUERIES: dict = {
    "op1_pattern_grammar": toxicity.op1,
    "op2_bit_sliced_top_k": bitsliced.op2,
    "op3_motion_jpeg": avi.op3,
    "op4_weighted_minhash": weighted_minhash.op4,
    "op5_line_windows": lines.op5,
    "op6_byte_pairs": bpe.op6,
    "op7_best_fit": packing.op7,
    "op8_interleaved_rans": rans.op8,
    "op9_induced_suffixes": suffixes.op9,
    "op10_fixed_anchors": anchors.op10,
}
ORACLE_SQL: dict[str, str] = {
    "op2_bit_sliced_top_k": bitsliced.OP2_SQL,
    "op5_line_windows": lines.OP5_SQL,
    "op9_induced_suffixes": suffixes.OP9_SQL,
    "op10_fixed_anchors": anchors.OP10_SQL,
}
