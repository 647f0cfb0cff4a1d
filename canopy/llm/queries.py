"""Queries of the training-data operators and the SQL that some can be held to."""

from __future__ import annotations

from collections.abc import Callable

from . import oracles
from .packing import op4
from .piece_tokens import op1
from .quality_classifier import op2
from .quality_rules import op3
from .secret_scan import op5
from .simhash import op9
from .training_order import op10
from .url_filter import op8
from .vector_dedup import op6
from .warc import op7


def queries() -> dict[str, Callable]:
    return {
        "op1_sentencepiece": op1,
        "op2_quality_classifier": op2,
        "op3_quality_rules": op3,
        "op4_packing": op4,
        "op5_secret_scans": op5,
        "op6_vector_dedup": op6,
        "op7_warc": op7,
        "op8_url_filters": op8,
        "op9_simhash": op9,
        "op10_training_order": op10,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_quality_rules": oracles.QUALITY_RULES,
        "op5_secret_scans": oracles.SECRET_SCANS,
        "op6_vector_dedup": oracles.VECTOR_DEDUP,
        "op7_warc": oracles.WARC,
        "op8_url_filters": oracles.URL_FILTERS,
    }
