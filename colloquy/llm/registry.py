"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from colloquy.llm.decontaminate import op3_decontaminate
from colloquy.llm.fingerprints import op9_fingerprints
from colloquy.llm.html_text import op6_html_text
from colloquy.llm.language_id import op4_language_id
from colloquy.llm.near_dedup import op1_near_dedup
from colloquy.llm.oracles import SQL
from colloquy.llm.secrets import op10_secret_scan
from colloquy.llm.sentencepiece import op8_sentencepiece
from colloquy.llm.substring_dedup import op2_substring_dedup
from colloquy.llm.suffix_dedup import op5_suffix_dedup
from colloquy.llm.toxicity import op7_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_near_dedup, op2_substring_dedup, op3_decontaminate, op4_language_id, op5_suffix_dedup, op6_html_text, op7_toxicity, op8_sentencepiece, op9_fingerprints, op10_secret_scan)} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
