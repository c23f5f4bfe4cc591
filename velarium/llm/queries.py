"""Queries over the given tables for the operators of this package, and their SQL."""

from __future__ import annotations

from .cover_tree import op1_cover_tree
from .lm_scoring import op8_lm_scoring
from .mixing import op7_mixing
from .oracles import OP1, OP6, OP9
from .packing import op10_packing
from .quality_model import op5_quality_classifier
from .quality_rules import op6_quality_rules
from .simhash import op3_simhash
from .suffix_dedup import op9_suffix_dedup
from .token_counts import op4_token_counts
from .toxicity import op2_toxicity

QUERIES = {
    "op1_cover_tree": op1_cover_tree,
    "op2_toxicity": op2_toxicity,
    "op3_simhash": op3_simhash,
    "op4_token_counts": op4_token_counts,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_quality_rules": op6_quality_rules,
    "op7_mixing": op7_mixing,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_packing": op10_packing,
}

ORACLES: dict[str, str] = {
    "op1_cover_tree": OP1,
    "op6_quality_rules": OP6,
    "op9_suffix_dedup": OP9,
}
