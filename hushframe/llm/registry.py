"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from hushframe.llm import (
    op1_url_filters,
    op2_quality_classifier,
    op3_toxicity,
    op4_media_columns,
    op5_substring_dedup,
    op6_quality_rules,
    op7_bpe,
    op8_mixing,
    op9_html_extraction,
    op10_ngram_jaccard,
    op11_filter_audit,
    op12_conversation_trie,
    op13_warc,
)

_MODULES = [
    op1_url_filters,
    op2_quality_classifier,
    op3_toxicity,
    op4_media_columns,
    op5_substring_dedup,
    op6_quality_rules,
    op7_bpe,
    op8_mixing,
    op9_html_extraction,
    op10_ngram_jaccard,
    op11_filter_audit,
    op12_conversation_trie,
    op13_warc,
]


def queries() -> dict:
    return {(name := m.__name__.rpartition(".")[2]): getattr(m, name) for m in _MODULES}


def oracle_sql() -> dict[str, str]:
    return {m.__name__.rpartition(".")[2]: m.ORACLE_SQL for m in _MODULES if getattr(m, "ORACLE_SQL", None)}
