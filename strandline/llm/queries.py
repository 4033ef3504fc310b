"""The queries of this subpackage, by name, and DuckDB SQL for those that SQL can express."""

from .decontaminate import op4_decontamination
from .exact_dedup import OP5_SQL, op5_exact_dedup
from .kneser_ney import op1_lm_scoring
from .line_dedup import op10_line_dedup
from .mixing import op3_mixing
from .near_dedup import op7_near_dedup
from .quality import op9_quality_classifier
from .secrets import op8_secret_scan
from .toxicity import op6_toxicity
from .token_counts import op2_token_counts

QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_token_counts": op2_token_counts,
    "op3_mixing": op3_mixing,
    "op4_decontamination": op4_decontamination,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_near_dedup": op7_near_dedup,
    "op8_secret_scan": op8_secret_scan,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_line_dedup": op10_line_dedup,
}

ORACLE_SQL = {"op5_exact_dedup": OP5_SQL}
