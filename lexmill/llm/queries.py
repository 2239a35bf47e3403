"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import collocations, mixing, quality_rules, url_filter
from .collocations import op11_collocations
from .fingerprints import op3_order_minhash
from .language_id import op5_language_id
from .mixing import op9_mix_to_weights
from .ngram_join import op4_ngram_jaccard_join
from .packing import op1_harmonic_packing
from .periodic_runs import op12_periodic_runs
from .quality_rules import op2_quality_rules
from .secret_scan import op8_secret_scans
from .sentence_pieces import op13_sentence_pieces
from .token_counts import op6_token_counts
from .toxicity import op7_toxicity
from .url_filter import op10_url_filter, op10_url_filter_whole

_QUERIES = [
    op1_harmonic_packing,
    op2_quality_rules,
    op3_order_minhash,
    op4_ngram_jaccard_join,
    op5_language_id,
    op6_token_counts,
    op7_toxicity,
    op8_secret_scans,
    op9_mix_to_weights,
    op10_url_filter,
    op10_url_filter_whole,
    op11_collocations,
    op12_periodic_runs,
    op13_sentence_pieces,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": quality_rules.ORACLE, "op9_mix_to_weights": mixing.ORACLE, "op10_url_filter": url_filter.ORACLE, "op11_collocations": collocations.ORACLE}
