"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe_codec import op10_bpe_codec
from .centroids import OP11_SQL, op11_centroid_clustering
from .decontamination import OP8_SQL, op8_decontamination
from .fill_in_middle import OP12_SQL, op12_fill_in_middle
from .line_dedup import OP9_SQL, op9_line_dedup
from .lm_scoring import op6_lm_scoring
from .quality_classifier import op2_quality_classifier
from .quality_rules import OP4_SQL, op4_quality_rules
from .sharding import op13_sharding
from .simhash import op7_simhash
from .token_counts import op1_token_counts
from .token_store import op3_token_store
from .warc import OP5_SQL, op5_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_quality_classifier": op2_quality_classifier,
        "op3_token_store": op3_token_store,
        "op4_quality_rules": op4_quality_rules,
        "op5_warc": op5_warc,
        "op6_lm_scoring": op6_lm_scoring,
        "op7_simhash": op7_simhash,
        "op8_decontamination": op8_decontamination,
        "op9_line_dedup": op9_line_dedup,
        "op10_bpe_codec": op10_bpe_codec,
        "op11_centroid_clustering": op11_centroid_clustering,
        "op12_fill_in_middle": op12_fill_in_middle,
        "op13_sharding": op13_sharding,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_quality_rules": OP4_SQL,
        "op5_warc": OP5_SQL,
        "op8_decontamination": OP8_SQL,
        "op9_line_dedup": OP9_SQL,
        "op11_centroid_clustering": OP11_SQL,
        "op12_fill_in_middle": OP12_SQL,
    }
