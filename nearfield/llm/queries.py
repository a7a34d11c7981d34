"""The queries of this subpackage, by name, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from .bpe import op6_bpe
from .cotraining import op3_cotraining
from .decontamination import op2_decontamination
from .fill_in_middle import op12_fill_in_middle
from .fingerprints import op11_fingerprints
from .html_text import op5_html_text
from .jaccard_join import op4_jaccard_join
from .language_id import op9_language_id
from .oracle import ORACLE_SQL as ORACLE_SQL
from .periodic_runs import op13_periodic_runs
from .pii import op8_pii
from .quality_rules import op10_quality_rules
from .substring_dedup import op1_substring_dedup
from .suffix_dedup import op7_suffix_dedup

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_cotraining": op3_cotraining,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_html_text": op5_html_text,
    "op6_bpe": op6_bpe,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_pii": op8_pii,
    "op9_language_id": op9_language_id,
    "op10_quality_rules": op10_quality_rules,
    "op11_fingerprints": op11_fingerprints,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_periodic_runs": op13_periodic_runs,
}
