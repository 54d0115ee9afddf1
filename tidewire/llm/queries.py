"""Registered queries of this package: opN_<name> applied to whole tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewire.llm.audit import OP12_SQL, op12_filter_interaction_audit
from tidewire.llm.decontamination import OP8_SQL, op8_benchmark_decontamination
from tidewire.llm.edits import op7_token_counts
from tidewire.llm.fingerprints import op1_fingerprints
from tidewire.llm.licences import OP2_SQL, op2_license_scans
from tidewire.llm.packing import op3_packing
from tidewire.llm.pii import op5_pii
from tidewire.llm.quality import op10_quality_classifier
from tidewire.llm.sharding import op6_sharding
from tidewire.llm.simhash import op9_simhash_near_dedup
from tidewire.llm.suffix_tree import op13_lm_scoring
from tidewire.llm.suffixes import op4_suffix_array_dedup
from tidewire.llm.turn_trie import OP11_SQL, op11_conversation_prefix_trie
from tidewire.sources.mart import read_mart

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _over(name: str, operator: Callable[..., DataFrame], *tables: str, sql: str | None = None) -> None:
    if sql:
        ORACLES[name] = sql
    QUERIES[name] = lambda spark, folder: operator(*(read_mart(spark, folder, t) for t in tables))


_over("op1_fingerprints", op1_fingerprints, "documents")
_over("op2_license_scans", op2_license_scans, "documents", sql=OP2_SQL)
_over("op3_packing", op3_packing, "documents")
_over("op4_suffix_array_dedup", op4_suffix_array_dedup, "documents")
_over("op5_pii", op5_pii, "documents")
_over("op6_sharding", op6_sharding, "documents")
_over("op7_token_counts", op7_token_counts, "documents")
_over("op8_benchmark_decontamination", op8_benchmark_decontamination, "documents", "benchmark", sql=OP8_SQL)
_over("op9_simhash_near_dedup", op9_simhash_near_dedup, "documents")
_over("op10_quality_classifier", op10_quality_classifier, "documents", "labels")
_over("op11_conversation_prefix_trie", op11_conversation_prefix_trie, "conversations", sql=OP11_SQL)
_over("op12_filter_interaction_audit", op12_filter_interaction_audit, "documents", "labels", sql=OP12_SQL)
_over("op13_lm_scoring", op13_lm_scoring, "documents")
