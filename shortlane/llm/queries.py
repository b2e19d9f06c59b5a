"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from .codes import op13_vector_code_compression
from .decontaminate import op10_benchmark_decontamination
from .hamming import OP4_SQL, op4_exact_top_k
from .lines import op9_line_dedup
from .mixing import op8_mixing_sources
from .ngram_join import op2_ngram_jaccard
from .packing import op11_best_fit_packing
from .pii import op3_personal_data
from .quality import op7_quality_classifier
from .runs import op12_periodic_run_detection
from .secrets import op1_secret_scans
from .substrings import op6_substring_dedup
from .toxicity import op5_toxicity


def queries() -> dict:
    found = (
        op1_secret_scans, op2_ngram_jaccard, op3_personal_data, op4_exact_top_k, op5_toxicity,
        op6_substring_dedup, op7_quality_classifier, op8_mixing_sources, op9_line_dedup, op10_benchmark_decontamination,
        op11_best_fit_packing, op12_periodic_run_detection, op13_vector_code_compression,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_top_k": OP4_SQL}
