"""Queries of the text operators on their tables, and check SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stopwise.llm import (
    conversation_repair, conversation_trie, decontaminate, exact_dedup, line_dedup, main_text, near_dedup, personal_data, quality, simhash,
    spm_tokens, suffix_dedup, toxicity)
from stopwise.llm.store import read


def _documents(run: Callable[..., DataFrame], *others: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run(read(spark, sf_dir, "documents"), *(read(spark, sf_dir, t) for t in others))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": _documents(suffix_dedup.suffix_dedup),
    "op2_line_dedup": _documents(line_dedup.digest),
    "op3_near_dedup": _documents(near_dedup.near_dedup),
    "op4_quality": _documents(quality.quality, "labels"),
    "op5_personal_data": _documents(personal_data.personal_data),
    "op6_exact_dedup": _documents(exact_dedup.exact_dedup),
    "op7_spm_tokens": _documents(spm_tokens.digest),
    "op8_toxicity": _documents(toxicity.toxicity, "labels"),
    "op9_decontaminate": _documents(decontaminate.decontaminate, "benchmark"),
    "op10_main_text": lambda spark, sf_dir: main_text.main_text(read(spark, sf_dir, "pages")),
    "op11_conversation_repair": lambda spark, sf_dir: conversation_repair.conversation_repair(read(spark, sf_dir, "conversations")),
    "op12_prefix_trie": lambda spark, sf_dir: conversation_trie.prefix_trie(read(spark, sf_dir, "conversations")),
    "op13_simhash": _documents(simhash.simhash),
}
SQL: dict[str, str] = {"op6_exact_dedup": exact_dedup.SQL, "op9_decontaminate": decontaminate.SQL, "op3_near_dedup": near_dedup.SQL,
                       "op12_prefix_trie": conversation_trie.SQL, "op11_conversation_repair": conversation_repair.SQL}
