"""The thin queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, hpylm, langid, mixing, quality, sharding, simhash, substring, winnow


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (hpylm.op2_lm_scoring, langid.op4_language_id, mixing.op1_mix_sources, sharding.op5_sharding, simhash.op3_simhash_neardup, winnow.op6_winnowing, bpe.op7_bpe_roundtrip, substring.op8_substring_dedup, quality.op9_quality_classifier, ann.op10_ann_search)}


def oracle_sql() -> dict[str, str]:
    return {"op8_substring_dedup": substring.OP8_SQL}
