"""Queries of this subpackage and, where SQL can express one, its oracle."""

from __future__ import annotations

from .fingerprint import op7_minhash_fingerprints
from .lm import op1_deleted_interpolation
from .media import op5_telephony_audio
from .mixing import op9_raked_mixture
from .omh import op6_order_minhash
from .pii import op8_anchor_pii
from .rlz import OP4_SQL, op4_lz_substrings
from .spm import op3_streaming_viterbi
from .toxicity import op10_conv_toxicity
from .urls import op2_boosted_urls

QUERIES = {
    "op1_deleted_interpolation": op1_deleted_interpolation,
    "op6_order_minhash": op6_order_minhash,
    "op7_minhash_fingerprints": op7_minhash_fingerprints,
    "op2_boosted_urls": op2_boosted_urls,
    "op3_streaming_viterbi": op3_streaming_viterbi,
    "op4_lz_substrings": op4_lz_substrings,
    "op5_telephony_audio": op5_telephony_audio,
    "op8_anchor_pii": op8_anchor_pii,
    "op9_raked_mixture": op9_raked_mixture,
    "op10_conv_toxicity": op10_conv_toxicity,
}

ORACLE_SQL = {"op4_lz_substrings": OP4_SQL}
