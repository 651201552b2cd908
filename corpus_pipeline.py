"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again for the next.

language_id            drops documents without a determined language
near_duplicates        keeps one document of each group of near copies
decontamination        drops documents that contain benchmark items
source_mixing          thins large sources and repeats small ones to flatter weights
token_files            encodes the mixture into token files; returns one row per document in them

All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wardline.llm import decontamination, langid, mixing, near_duplicates, token_files
from wardline.llm.common import cut_lineage, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language_id", langid.stage),
    ("near_duplicates", near_duplicates.stage),
    ("decontamination", decontamination.stage),
    ("source_mixing", mixing.stage),
    ("token_files", token_files.stage),
]

#: Tokenizer ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
