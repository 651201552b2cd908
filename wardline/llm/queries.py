"""The registered queries of this package and the SQL that some of them must equal."""

from __future__ import annotations

from wardline.llm import (
    code_compression, decontamination, embedding_dedup, exact_dedup, filter_audit, html_text, langid, mixing, near_duplicates, token_counts,
    token_files, url_filter, warc,
)
from wardline.llm.common import Query

QUERIES: dict[str, Query] = {
    "op1_url_filter": url_filter.op1,
    "op2_token_counts": token_counts.op2,
    "op3_language_id": langid.op3,
    "op4_ngram_jaccard": near_duplicates.op4,
    "op5_source_mixing": mixing.op5,
    "op6_embedding_dedup": embedding_dedup.op6,
    "op7_decontamination": decontamination.op7,
    "op8_warc": warc.op8,
    "op9_token_files": token_files.op9,
    "op10_html_text": html_text.op10,
    "op11_exact_dedup": exact_dedup.op11,
    "op12_filter_audit": filter_audit.op12,
    "op13_code_compression": code_compression.op13,
}
ORACLES: dict[str, str] = {
    "op1_url_filter": url_filter.ORACLE,
    "op4_ngram_jaccard": near_duplicates.ORACLE,
    "op5_source_mixing": mixing.ORACLE,
    "op6_embedding_dedup": embedding_dedup.ORACLE,
    "op7_decontamination": decontamination.ORACLE,
    "op11_exact_dedup": exact_dedup.ORACLE,
    "op12_filter_audit": filter_audit.ORACLE,
    "op13_code_compression": code_compression.ORACLE,
}
