"""The subpackage's queries and their SQL."""

from __future__ import annotations

from . import op7_exact, op8_decontaminate
from .op1_sentencepiece import op1_sentencepiece
from .op2_substring import op2_substring_dedup
from .op3_lm import op3_lm_scoring
from .op4_quality import op4_quality
from .op5_license import op5_license_scan
from .op6_toxicity import op6_toxicity
from .op7_exact import op7_exact_dedup
from .op8_decontaminate import op8_decontamination
from .op9_tokens import op9_token_counts
from .op10_simhash import op10_simhash_near_dedup

QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_substring_dedup, op3_lm_scoring, op4_quality, op5_license_scan, op6_toxicity, op7_exact_dedup, op8_decontamination, op9_token_counts, op10_simhash_near_dedup)}
ORACLES = {"op7_exact_dedup": op7_exact.ORACLE_SQL, "op8_decontamination": op8_decontaminate.ORACLE_SQL}
