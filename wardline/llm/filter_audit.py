"""Interaction of five filters: what each removes in every order, what it shares with the others, and what it costs."""

from __future__ import annotations

from itertools import permutations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import IntegerType

from wardline.llm.common import attach, cut_lineage, table
from wardline.llm.exchange import may_repeat

LETTERS = "ABCDE"
#: Counters of the Bloom sketch a row (rounded up to a power of two in all) and counters each text touches.
COUNTERS, HASHES = 12, 4
_UPPER, _MARKS = bytes(range(ord("A"), ord("Z") + 1)), b"#$%&*|"


@F.arrow_udf(IntegerType())
def text_flags(texts: pa.Array) -> pa.Array:
    """Failures of the four filters that look at one text alone, as bits: A 1, B 2, C 4, D 8."""
    points = pc.utf8_length(texts).to_pylist()
    out = []
    for data, length in zip(texts.cast(pa.large_binary()), points):
        data = data.as_py()
        words = data.split()  # of bytes: exactly the six ASCII white-space characters
        flags = (len(words) < 100) + 2 * (100 * len(set(words)) < 80 * len(words))
        flags += 4 * (100 * (len(data) - len(data.translate(None, _UPPER))) > 10 * length)
        out.append(flags + 8 * (len(data.translate(None, _MARKS)) < len(data)))
    return pa.array(out, pa.int32())


def failure_masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask) for each row of docs (doc_id, text, lang): bit i of mask is failure of the filter LETTERS[i].

    Null text counts as empty, null lang is the part ''. A row without id is no repeat and makes none; rows that share an id are no
    repeats of each other. Other columns are not read.

    Counting-Bloom prepass: merged sketches clear the texts that are certainly unique; only possible repeats are grouped by their whole
    text for the smallest id, with partial aggregates before the shuffle.
    """
    held = cut_lineage(
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
                    F.coalesce("text", F.lit("")).alias("text"))
        .select("*", F.monotonically_increasing_id().alias("row"), F.xxhash64("text").alias("key"), F.sha2("text", 256).alias("sha"),
                text_flags("text").alias("mask")))
    flagged = held.withColumn("repeat", may_repeat(held, "row", "key", COUNTERS, HASHES))
    groups = cut_lineage(
        flagged.filter("repeat").groupBy("sha", "text").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).drop("text"))
    rows = cut_lineage(flagged.select("doc_id", "part", "mask", "sha", "repeat"))
    later = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).cast("int") * (1 << LETTERS.index("E"))
    checked = attach(rows.filter("repeat"), groups, "sha", "n")
    return checked.select("doc_id", "part", (F.col("mask") + later).alias("mask")).unionByName(
        rows.filter("NOT repeat").select("doc_id", "part", "mask"))


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents, and those that any row of labels (doc_id, quality, toxic) calls good or toxic."""
    masks = cut_lineage(masks)
    known = labels.groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    zero = F.lit(0).cast("bigint")
    counted = masks.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n")).select("*", zero.alias("good"), zero.alias("toxic"))
    labelled = masks.join(known.filter("doc_id IS NOT NULL"), "doc_id").groupBy("part", "mask").agg(
        zero.alias("n"), F.coalesce(F.sum("good"), zero).alias("good"), F.coalesce(F.sum("toxic"), zero).alias("toxic"))
    return cut_lineage(counted.unionByName(labelled).groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic"))))


def order_report(counts: DataFrame) -> DataFrame:
    """One row per part, order and step from the mask counts, which are few: at most 32 a part."""
    orders = F.array(*(F.lit("".join(p)) for p in permutations(LETTERS)))
    steps = counts.select("*", F.explode(orders).alias("filter_order")).select(
        "*", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("step"))
    steps = steps.withColumn("letter", F.substring("filter_order", F.col("step"), F.lit(1)))

    def fails(letter: str) -> Column:
        return F.col("mask").bitwiseAND(1 << LETTERS.index(letter)) != 0

    before, here = F.lit(False), F.lit(False)
    for letter in LETTERS:
        before = before | (fails(letter) & (F.instr("filter_order", letter) < F.col("step")))
        here = here | (fails(letter) & (F.col("letter") == letter))
    alone = here & F.col("mask").isin([1 << i for i in range(len(LETTERS))])
    steps = steps.select("*", before.alias("before"), here.alias("here"), alone.alias("alone"))

    def total(which: str, of: str = "n") -> Column:
        return F.sum(F.when(F.expr(which), F.col(of)).otherwise(0)).cast("bigint")

    report = steps.groupBy("part", "filter_order", "step", "letter").agg(
        total("NOT before AND NOT here").alias("kept"), total("NOT before AND here").alias("removed"),
        total("before AND here").alias("redundant"), total("alone").alias("unique_fails"),
        total("NOT before AND here", "good").alias("good_lost"), total("NOT before AND here", "toxic").alias("toxic_lost"))
    # 120 rows a letter and part, whatever the documents.
    return report.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("letter")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The report of all orders; an empty table has no part and gives no row."""
    return order_report(mask_counts(failure_masks(docs), labels))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM t),
f AS (
  SELECT doc_id, part, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w),
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > least, false)] AS f
  FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, f, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM f LEFT JOIN l ON f.doc_id = l.doc_id GROUP BY part, f),
x AS (SELECT unnest(range(1, 6)) AS x),
o AS (
  SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (
  SELECT part, n, good, toxic, o, x.x AS step, o[x.x] AS letter, f[o[x.x]] AS here,
    len(list_filter(o[:x.x - 1], lambda i: f[i])) > 0 AS before, len(list_filter(f, lambda i: i)) = 1 AS one
  FROM m, o, x),
r AS (
  SELECT part, array_to_string(list_transform(o, lambda i: 'ABCDE'[i]), '') AS filter_order, CAST(step AS INTEGER) AS step, letter,
    sum(CASE WHEN NOT before AND NOT here THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT before AND here THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN before AND here THEN n ELSE 0 END) AS redundant, sum(CASE WHEN one AND here THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN NOT before AND here THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT before AND here THEN toxic ELSE 0 END) AS toxic_lost
  FROM s GROUP BY part, o, step, letter)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM r
"""
