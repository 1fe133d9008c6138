"""Queries over the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wattloom.llm.alignment import op11_token_alignment
from wattloom.llm.chat import OP7_SQL, op7_chat_format
from wattloom.llm.embedding_dedup import OP6_SQL, op6_embedding_dedup
from wattloom.llm.language_id import op3_language_id
from wattloom.llm.line_dedup import OP12_SQL, op12_line_dedup
from wattloom.llm.packing import op5_packing
from wattloom.llm.quality import STATISTICS_SQL, op8_quality_rules, quality_statistics
from wattloom.llm.sentencepiece_viterbi import op1_sentencepiece
from wattloom.llm.simhash import op10_simhash_near_dedup
from wattloom.llm.substring_dedup import op9_substring_dedup
from wattloom.llm.token_file import op2_token_file
from wattloom.llm.warc import OP4_SQL, op4_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_token_file": op2_token_file,
    "op3_language_id": op3_language_id,
    "op4_warc": op4_warc,
    "op5_packing": op5_packing,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_chat_format": op7_chat_format,
    "op8_quality_rules": op8_quality_rules,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_token_alignment": op11_token_alignment,
    "op12_line_dedup": op12_line_dedup,
    "quality_statistics": quality_statistics,
}
ORACLE_SQL: dict[str, str] = {
    "op4_warc": OP4_SQL,
    "op6_embedding_dedup": OP6_SQL,
    "op7_chat_format": OP7_SQL,
    "op12_line_dedup": OP12_SQL,
    "quality_statistics": STATISTICS_SQL,
}
