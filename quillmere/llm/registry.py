"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .importance import op11_importance
from .language_id import op12_language_id
from .license_scan import op1_license_scan
from .ngram_join import op4_ngram_join
from .packing import op7_packing
from .periodic_runs import op13_periodic_runs
from .quality_rules import op10_quality_rules
from .sql import ORACLES
from .sentencepieces import op3_sentencepieces
from .suffix_dedup import op6_suffix_dedup
from .token_counts import op2_token_counts
from .topk_search import op8_topk_search
from .toxicity import op9_toxicity
from .warc import op5_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_token_counts": op2_token_counts,
        "op3_sentencepieces": op3_sentencepieces,
        "op4_ngram_join": op4_ngram_join,
        "op5_warc": op5_warc,
        "op6_suffix_dedup": op6_suffix_dedup,
        "op7_packing": op7_packing,
        "op8_topk_search": op8_topk_search,
        "op9_toxicity": op9_toxicity,
        "op10_quality_rules": op10_quality_rules,
        "op11_importance": op11_importance,
        "op12_language_id": op12_language_id,
        "op13_periodic_runs": op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
