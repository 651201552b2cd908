"""Exact duplicates of whole texts: Golomb-coded fingerprints go to owners, bitmaps come back, suspects are compared byte by byte."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wardline.llm.common import attach, cut_lineage, table
from wardline.llm.exchange import may_repeat

#: Fingerprints are drawn from so many values a row: one in so many unique texts is a suspect as well.
PER_KEY = 1024


def normalised(text: Column) -> Column:
    """Null as empty, each run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for each row of docs (doc_id, text).

    The row with the smallest id of equal texts stays; rows without id come last, and of rows with the same id one stays (which of
    them shows in no column). A group without any id has a null keep_id. Other columns of docs are not read.

    The normalised texts are written once with fixed row numbers. Suspects alone are grouped by their text, with partial
    aggregates before the shuffle, so a text with a third of all rows sends one row a task; rows get their group's facts by the
    SHA-256 of the text.
    """
    held = cut_lineage(
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), normalised(F.col("text")).alias("text"))
        .select("*", F.monotonically_increasing_id().alias("row"), F.xxhash64("text").alias("key"), F.sha2("text", 256).alias("text_sha256")))
    flagged = held.withColumn("suspect", may_repeat(held, "row", "key", PER_KEY, hashes=1))
    groups = cut_lineage(
        flagged.filter("suspect").groupBy("text_sha256", "text")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"), F.count(F.lit(1)).alias("group_size"))
        .select("text_sha256", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"), "group_size"))
    rows = cut_lineage(flagged.select("doc_id", "row", "text_sha256", "suspect"))
    grouped = attach(rows.filter("suspect"), groups, "text_sha256", "group_size")
    single = rows.filter("NOT suspect").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return grouped.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256").unionByName(single)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM t
"""
