"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from .alignment import op11_alignment
from .bpe import op5_bpe
from .decontaminate import op3_decontaminate
from .exact_dedup import OP8_SQL, op8_exact_dedup
from .jaccard_join import op6_jaccard_join
from .language import op7_language
from .quality import op2_quality
from .quality_rules import OP13_SQL, op13_quality_rules
from .substring_dedup import op4_substring_dedup
from .suffix_dedup import op9_suffix_dedup
from .token_counts import op10_token_counts
from .token_files import op1_token_files
from .whitening import op12_whitening

QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_quality": op2_quality,
    "op3_decontaminate": op3_decontaminate,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_bpe": op5_bpe,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_language": op7_language,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_token_counts": op10_token_counts,
    "op11_alignment": op11_alignment,
    "op12_whitening": op12_whitening,
    "op13_quality_rules": op13_quality_rules,
}
SQL = {"op8_exact_dedup": OP8_SQL, "op13_quality_rules": OP13_SQL}
