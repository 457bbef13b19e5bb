"""The queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

import importlib.util
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from latticework.llm import decontamination, html_templates, language_id, lm_scoring, mixing, preference, quality_rules, simhash, suffix_dedup, token_counts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    """A file of the public tokenizers' folder: $TOKENIZERS, /opt/tokenizers or the installed package."""
    found = importlib.util.find_spec("public_tokenizers")
    for folder in (os.environ.get("TOKENIZERS"), "/opt/tokenizers", found and os.path.dirname(found.origin)):
        if folder and os.path.exists(os.path.join(folder, name)):
            return os.path.join(folder, name)
    raise FileNotFoundError(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": lambda s, d: quality_rules.judge(table(s, d, "documents")),
    "op2_chat_formatting": lambda s, d: preference.from_conversations(table(s, d, "conversations")),
    "op3_simhash": lambda s, d: simhash.removed(table(s, d, "documents")),
    "op4_lm_scoring": lambda s, d: lm_scoring.score(table(s, d, "documents"), table(s, d, "labels")),
    "op5_decontamination": lambda s, d: decontamination.matches(table(s, d, "documents"), table(s, d, "benchmark")),
    "op6_token_counts": lambda s, d: token_counts.count(table(s, d, "documents"), vocabulary()),
    "op7_language_id": lambda s, d: language_id.spans(table(s, d, "documents")),
    "op8_suffix_dedup": lambda s, d: suffix_dedup.repeats(table(s, d, "documents")),
    "op9_mixing": lambda s, d: mixing.plan(table(s, d, "documents")),
    "op10_html_extraction": lambda s, d: html_templates.extract(table(s, d, "pages")),
}

ORACLES: dict[str, str] = {
    "op1_quality_rules": quality_rules.ORACLE,
    "op2_chat_formatting": preference.ORACLE,
    "op4_lm_scoring": lm_scoring.ORACLE,
    "op8_suffix_dedup": suffix_dedup.ORACLE,
    "op9_mixing": mixing.ORACLE,
}
