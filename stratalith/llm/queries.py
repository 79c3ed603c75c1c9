"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann_forest import op4_ann_forest
from .best_fit_packing import op1_best_fit_packing
from .hard_negatives import op13_hard_negatives
from .language_id import op6_language_id
from .license_scan import op9_license_scan
from .minhash_dedup import op7_minhash_dedup
from .pivot_dedup import op8_pivot_dedup
from .quality_classifier import op2_quality_classifier
from .sort_means import op11_sort_means
from .source_mixing import op10_source_mixing
from .sql import HARD_NEGATIVES, sort_means_sql
from .substring_dedup import op3_substring_dedup
from .token_counts import op5_token_counts
from .token_files import op12_token_files


OPERATORS = [
    op1_best_fit_packing, op2_quality_classifier, op3_substring_dedup, op4_ann_forest, op5_token_counts, op6_language_id, op7_minhash_dedup,
    op8_pivot_dedup, op9_license_scan, op10_source_mixing, op11_sort_means, op12_token_files, op13_hard_negatives,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {"op11_sort_means": sort_means_sql(), "op13_hard_negatives": HARD_NEGATIVES}
