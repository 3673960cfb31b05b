"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tessera.llm import chat, decontamination, language_model, mixing, multiset, pii, quality, secrets, simhash, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": decontamination.op1_decontamination,
    "op2_pii": pii.op2_pii,
    "op3_secrets": secrets.op3_secrets,
    "op4_simhash": simhash.op4_simhash,
    "op5_language_model": language_model.op5_language_model,
    "op6_fingerprints": multiset.op6_fingerprints,
    "op7_quality": quality.op7_quality,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_chat": chat.op9_chat,
    "op10_mixing": mixing.op10_mixing,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op2_pii": pii.ORACLE_SQL,
    "op3_secrets": secrets.ORACLE_SQL,
    "op9_chat": chat.ORACLE_SQL,
    "op10_mixing": mixing.ORACLE_SQL,
}
