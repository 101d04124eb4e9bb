"""The queries of this subpackage, and the SQL that each is compared with where SQL expresses it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakefold.llm import brown_lm, chat_format, decontaminate, html_text, near_dedup, packing, periodic_runs, quality, spelling_variants, substring_dedup, token_store, topk_search, viterbi_count

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_brown_lm": brown_lm.op1_brown_lm,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op3_chat_format": chat_format.op3_chat_format,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_token_counts": viterbi_count.op5_token_counts,
    "op6_token_store": token_store.op6_token_store,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_html_text": html_text.op8_html_text,
    "op9_packing": packing.op9_packing,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_spelling_variants": spelling_variants.op11_spelling_variants,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_topk_search": topk_search.op13_topk_search,
}
ORACLES: dict[str, str] = {
    "op3_chat_format": chat_format.ORACLE,
    "op13_topk_search": topk_search.ORACLE,
}
