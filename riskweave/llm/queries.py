"""The training-data queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from riskweave.llm.chat import op3_template_chat_format
from riskweave.llm.embedding import op9_spherical_kmeans_dedup
from riskweave.llm.fingerprint import op5_bottom_k_fingerprints
from riskweave.llm.language import op10_cross_parsing_language
from riskweave.llm.licenses import op7_license_scan
from riskweave.llm.lines import op4_fuzzy_line_dedup
from riskweave.llm.mixing import op2_sainte_lague_mix
from riskweave.llm.packing import op6_sum_of_squares_packing
from riskweave.llm.simhash import op8_pigeonring_simhash
from riskweave.llm.toxicity import op1_counterfactual_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        op1_counterfactual_toxicity,
        op2_sainte_lague_mix,
        op3_template_chat_format,
        op4_fuzzy_line_dedup,
        op5_bottom_k_fingerprints,
        op6_sum_of_squares_packing,
        op7_license_scan,
        op8_pigeonring_simhash,
        op9_spherical_kmeans_dedup,
        op10_cross_parsing_language,
    ]
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {}
