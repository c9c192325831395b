"""The queries and SQL of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from oreflow.llm import (
    chat_format, chunk_encoding, collocations, fill_in_middle, html_extraction, language_id, ngram_join, packing, personal_data,
    phrase_fingerprint, quality_model, quality_rules, token_output,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": quality_rules.query,
    "op2_quality_model": quality_model.query,
    "op3_ngram_join": ngram_join.query,
    "op4_chat_format": chat_format.query,
    "op5_language_id": language_id.query,
    "op6_phrase_fingerprint": phrase_fingerprint.query,
    "op7_html_extraction": html_extraction.query,
    "op8_token_output": token_output.query,
    "op9_packing": packing.query,
    "op10_chunk_encoding": chunk_encoding.query,
    "op11_personal_data": personal_data.query,
    "op12_collocations": collocations.query,
    "op13_fill_in_middle": fill_in_middle.query,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": quality_rules.ORACLE_SQL,
    "op3_ngram_join": ngram_join.ORACLE_SQL,
    "op12_collocations": collocations.ORACLE_SQL,
    "op13_fill_in_middle": fill_in_middle.ORACLE_SQL,
}
